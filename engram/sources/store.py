"""Tables of chunks, vectors, sessions and events on disk: readers with defaults, and writers."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import vectors as V

#: What a missing field of a chunk counts as.
DEFAULTS = {"confidence": 0.5, "staleness": 0.0, "entropy": 0.0, "quality": 0.5, "verified": False}

CHUNK = """topic string, chunk_id string, text string, text_hash string, confidence double, staleness double, entropy double,
    quality double, verified boolean, verification double, ts timestamp, ttl_ts timestamp, source_refs array<string>, embedding array<float>"""
EVENT = "event_id long, ts timestamp, event_type string, topic string, chunk_key string, details map<string,string>"
TURN = "ts timestamp, role string, text string"


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(df[c], F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()})


def read_chunks(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Chunks of a store, of some topics only if they are named: other partitions aren't read."""
    df = spark.read.option("ignoreCorruptFiles", "true").schema(CHUNK).parquet(path)
    return with_defaults(df.where(F.col("topic").isin(topics)) if topics else df)


def write_chunks(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Overwrites the topics that df has and no others; a large topic goes to several tasks."""
    df.hint("rebalance", F.col("topic")).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("topic").parquet(path)


def export(df: DataFrame, path: str, vectors: bool = True) -> None:
    out = df if vectors else df.drop("embedding")
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_topic(df: DataFrame, topic: str, vectors: bool = False) -> DataFrame:
    """One topic's chunks, without what only the engine needs unless it is asked for."""
    rows = df.where(F.col("topic") == topic)
    return rows if vectors else rows.drop("embedding", "embedding_q")


def export_quantized(df: DataFrame, path: str, bits: int = 6) -> None:
    """Vectors as packed bytes with scale and width, a fifth of their size."""
    q = V.quantize(V.as_double("embedding"), bits)
    rows = df.withColumn("_q", q).withColumns({"data": V.pack(bits)("_q.values"), "scale": F.col("_q.scale"), "bits": F.lit(bits), "dim": F.col("_q.dim")})
    rows.drop("_q", "embedding").write.mode("overwrite").option("compression", "zstd").parquet(path)


def unpacked(df: DataFrame, bits: int = 6) -> DataFrame:
    """Rows of export_quantized with their vectors as doubles."""
    qmax = (1 << (bits - 1)) - 1
    values = V.unpack(bits)("data", "dim")
    return df.withColumn("_u", values).withColumn("embedding", F.transform("_u", lambda u: (u - qmax) * F.col("scale"))).drop("_u")


def import_parquet(spark: SparkSession, path: str, topic: str = "imported") -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("topic", F.coalesce(df["topic"], F.lit(topic)) if "topic" in df.columns else F.lit(topic))


def add_turns(turns: DataFrame, path: str) -> None:
    """Appends session turns as JSON lines, a folder a UTC day."""
    turns.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return messages(spark.read.schema(TURN).json(path))


def messages(turns: DataFrame) -> DataFrame:
    """Turns of known roles."""
    return turns.where(F.col("role").isin("user", "assistant", "system"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the files' SHA-256s in the order of their paths (not of their joined bytes)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: x["sha"]), ""), 256).alias("checksum"))


def backup(df: DataFrame, path: str) -> dict[str, int]:
    """A snapshot and its manifest of counts."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    spark = df.sparkSession
    saved = spark.read.parquet(f"{path}/chunks")
    manifest = saved.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("topic").alias("topics")).first().asDict()
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """The snapshot's chunks; with a target they replace what is there."""
    saved = spark.read.parquet(f"{path}/chunks")
    if target:
        write_chunks(saved, target)
        return spark.read.parquet(target)
    return saved


def ingest_status(items: DataFrame, reason: Column) -> DataFrame:
    """items with status: imported, excluded, or failed for null texts."""
    return items.withColumn("reason", reason).withColumn("status", F.when(F.col("text").isNull(), "failed").when(F.col("reason").isNotNull(), "excluded").otherwise("imported"))


def memory_index(chunks: DataFrame, lines: int = 30, most_bytes: int = 4096) -> DataFrame:
    """The best chunk of each topic as one line; only the first lines if all are over most_bytes."""
    best = chunks.groupBy("topic").agg(F.max_by("text", F.struct("confidence", F.negative("seq"))).alias("text"))
    line = F.concat(F.lit("- "), F.col("topic"), F.lit(": "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 100))
    rows = best.select("topic", line.alias("line"))
    size = F.broadcast(rows.agg(F.sum(F.octet_length("line") + 1).alias("_size")))  # one row
    first = rows.orderBy("topic").limit(lines).select("topic", F.lit(True).alias("_first"))
    rows = rows.join(first, "topic", "left").crossJoin(size).where(F.col("_first") | (F.col("_size") <= most_bytes))
    return rows.select("topic", "line").orderBy("topic")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
