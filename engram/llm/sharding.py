"""Weighted rendezvous hashing of stable record keys (operator 5) [native].

Every (key, shard) pair has a hash; a record goes to the shard with the largest weighted score
``-weight / ln(u)``, u being the hash mapped into (0, 1).  One more shard only takes the records
for which it scores highest; no record moves between the old shards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import materialise, running_totals, table


def rendezvous(key: Column, weights: Sequence[float], seed: int = 42) -> Column:
    """The shard (0 to len(weights) - 1) of a key; a shard of weight 0 gets nothing.

    Equal scores go to the larger shard number.  A null key hashes like any other value.
    """
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative, and not all zero")

    def score(shard: int) -> Column:
        # 52 bits of the hash, put into the open interval (0, 1)
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 12)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.lit(float(weights[shard])) / -F.log(u)

    scores = [F.struct(score(i).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], id_column: str = "doc_id", seed: int = 42) -> DataFrame:
    """docs with ``shard`` and ``grown_shard``, the latter with one more shard of the mean weight.

    Columns of these names are replaced.  Rows with one id, null included, share a shard.
    """
    mean = sum(weights) / len(weights)
    return docs.withColumns({"shard": rendezvous(docs[id_column], weights, seed), "grown_shard": rendezvous(docs[id_column], [*weights, mean], seed)})


def number_slots(rows: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """rows with ``slot``: 0, 1, 2 … without gaps within each group, in the order of a row hash.

    Equal rows are counted before they are put in order, so that no task orders more than a
    1024th of a group's distinct rows; which of them gets which of their slots makes no difference.
    """
    keys = [group, *columns]
    distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    distinct = distinct.withColumn("_hash", F.xxhash64(*columns))
    placed = running_totals(distinct, [group], ["_hash", *columns], F.col("_copies"), "_first")
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy")
    return placed.select(*keys, "_first", one).select(*keys, (F.col("_first") + F.col("_copy")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs.

    The law is ``key``: doc_id and the number of shards decide; texts and other columns don't.
    A null text has no bytes (size 1, crc32 of nothing: 0); null ids are one key.  Repeated rows
    each get a slot of their own.  An empty table gives an empty table.
    """
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = materialise(assign_shards(narrow, [1.0] * shards, seed=seed), "shards")
    slots = number_slots(narrow, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
