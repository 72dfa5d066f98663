"""Contradictions, decay, expiry, feedback, consolidation, merging and splitting of topics.

Time is an argument everywhere.  Chunks have topic, chunk_id and the columns that a function
names; every function takes and returns DataFrames and runs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import contradictions
from engram.operators.ordered import on_partitions

DAY = 86400.0
#: Chunks of a topic that one task holds against the topic's others; topics of up to so many chunks are joined.
PART, SMALL = 10_240, 64


def _large(rows: DataFrame) -> DataFrame:
    """(topic, parts) of large topics, of which there is one to SMALL rows at most."""
    n = F.count(F.lit(1))
    return F.broadcast(rows.groupBy("topic").agg(F.ceil(n / PART).cast("int").alias("parts"), n.alias("_n")).where(F.col("_n") > SMALL).drop("_n"))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def contradiction_pairs(chunks: DataFrame, rule=X.contradicts, newer: Column | None = None) -> DataFrame:
    """(topic, older, newer): contradicting pairs of one topic, in the order of ``seq``.

    With a condition ``newer`` only pairs whose later chunk meets it.  The result may have every
    pair, as texts with different numbers contradict.  A small topic's chunks are gathered and held
    against each other.  Large topics go through ``contradictions.links``, as do only the two fixed rules.
    """
    rows = chunks.select("topic", "seq", "text", (F.lit(True) if newer is None else newer).alias("new"))
    featured = ["topic", "seq", "new", X.contradiction_features(F.col("text")).alias("f")]
    if rule not in (X.contradicts, X.contradicts_short) or not isinstance(chunks.schema["seq"].dataType, IntegralType):
        a, b = rows.select(*featured).alias("a"), rows.where("new").select(*featured).alias("b")
        on = (F.col("a.topic") == F.col("b.topic")) & (F.col("a.seq") < F.col("b.seq"))
        return a.join(b, on).where(rule(F.col("a.f"), F.col("b.f"))).select(F.col("a.topic").alias("topic"), F.col("a.seq").alias("older"), F.col("b.seq").alias("newer"))
    large, whole = _large(rows), rule is X.contradicts
    linked = contradictions.links(rows.join(large, "topic"), _tasks(rows), X.NEGATIONS if whole else X.NEGATIONS_SHORT, whole, F.col("new"))

    def contradicted(a: Column) -> Column:
        later = F.filter("all", lambda b: (b["seq"] > a["seq"]) & b["new"] & rule(a["f"], b["f"]))
        return F.transform(later, lambda b: F.struct(a["seq"].alias("older"), b["seq"].alias("newer")))

    gathered = rows.where(F.col("topic").isNotNull()).join(large, "topic", "left_anti").select(*featured).groupBy("topic").agg(F.collect_list(F.struct("seq", "new", "f")).alias("all"))
    found = gathered.select("topic", F.explode(F.flatten(F.transform("all", contradicted))).alias("p"))
    return found.select("topic", "p.older", "p.newer").unionByName(linked)


def contradiction_decay(chunks: DataFrame, newer: Column | None = None) -> DataFrame:
    """Confidence times 0.6 and staleness plus 0.25 (at most 1) for each later contradiction.

    Texts don't change, so the sequence of updates has a closed form in their number.
    """
    n = contradiction_pairs(chunks, newer=newer).groupBy("topic", F.col("older").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    out = chunks.join(n, ["topic", "seq"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns({"confidence": F.col("confidence") * F.pow(F.lit(0.6), "n"), "staleness": F.least(F.lit(1.0), F.col("staleness") + 0.25 * F.col("n"))}).drop("n")


def resolve_contradictions(chunks: DataFrame, factor: float = 0.5) -> DataFrame:
    """Chunks that a newer one contradicts lose confidence once, and gain 0.3 staleness."""
    rows = chunks.select("topic", "seq", "text")
    if isinstance(chunks.schema["seq"].dataType, IntegralType):
        dealt = rows.join(_large(rows), "topic", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        found = contradictions.older(dealt, _tasks(rows), X.NEGATIONS_SHORT)
    else:
        found = contradiction_pairs(chunks, X.contradicts_short)
    hit = found.select("topic", F.col("older").alias("seq")).distinct().withColumn("hit", F.lit(True))
    out = chunks.join(hit, ["topic", "seq"], "left")
    return out.withColumns({"confidence": F.when(F.col("hit"), F.col("confidence") * factor).otherwise(F.col("confidence")), "staleness": F.when(F.col("hit"), F.least(F.lit(1.0), F.col("staleness") + 0.3)).otherwise(F.col("staleness"))}).drop("hit")


def half_life(confidence: Column, age_seconds: Column, half_life_days: float) -> Column:
    return confidence if half_life_days <= 0 else confidence * F.pow(F.lit(0.5), age_seconds / (half_life_days * DAY))


def e_folding(age_seconds: Column, days: float = 90.0) -> Column:
    return F.exp(-(age_seconds / DAY) / days)


def expired(created: Column, ttl_seconds: Column, as_of: Column) -> Column:
    """A ttl that is null or not positive never ends."""
    return F.coalesce((ttl_seconds > 0) & (F.unix_timestamp(as_of) - F.unix_timestamp(created) >= ttl_seconds), F.lit(False))


def decay_tick(chunks: DataFrame, as_of: Column, half_life_days: float = 30.0) -> DataFrame:
    """One tick: rows above 0.01 fall to 0 if expired, else by half-life if that is over 0.01."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("ts")
    new = half_life(F.col("confidence"), age, half_life_days)
    value = F.when(F.col("confidence") <= 0.01, F.col("confidence")).when(expired(F.col("ts"), F.col("ttl_seconds"), as_of), 0.0).when(F.abs(F.col("confidence") - new) > 0.01, new).otherwise(F.col("confidence"))
    return chunks.withColumn("confidence", value)


def quality_decay(chunks: DataFrame) -> DataFrame:
    new = F.greatest(F.lit(0.0), F.col("quality") - 0.01)
    return chunks.withColumns({"staleness": F.when(new != F.col("quality"), F.least(F.lit(1.0), F.col("staleness") + 0.005)).otherwise(F.col("staleness")), "quality": new})


def expire_ttl(chunks: DataFrame, as_of: Column) -> DataFrame:
    return chunks.where(F.col("ttl_ts").isNull() | (F.col("ttl_ts") >= as_of))


def apply_feedback(chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    """Deltas of (vec_id, seq, delta) in order, clamped to 0 and 1 after each."""
    listed = feedback.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]).alias("deltas"))
    folded = F.aggregate("deltas", F.col("confidence"), lambda c, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c + d)))
    return chunks.join(listed, "vec_id", "left").withColumn("confidence", F.when(F.col("deltas").isNull(), F.col("confidence")).otherwise(folded)).drop("deltas")


def prune(chunks: DataFrame, min_entropy: float = 0.10, max_staleness: float = 0.90) -> DataFrame:
    return chunks.where((F.col("entropy") >= min_entropy) & (F.col("staleness") <= max_staleness))


def first_of_each(chunks: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; only row_number = 1 leaves a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return chunks.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dedup(chunks: DataFrame) -> DataFrame:
    """The first chunk of each text of a topic, in the order of seq."""
    return first_of_each(chunks.withColumn("_sha1", F.sha1("text")), ["topic", "_sha1"], [F.col("seq")]).drop("_sha1")


def cap(chunks: DataFrame, most: int = 300) -> DataFrame:
    """The most confident chunks of each topic; ties by seq."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("confidence").desc(), "seq"))
    return chunks.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


class _Leaders:
    """The leaders of a topic so far, in a matrix that grows by doubling."""

    def __init__(self, dim: int) -> None:
        self.ids: list[int] = []
        self.matrix = np.zeros((16, dim))

    def add(self, name: int, vector: np.ndarray) -> None:
        if len(self.ids) == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[len(self.ids)] = vector
        self.ids.append(name)

    def assign(self, ids: list[int], m: np.ndarray, threshold: float) -> list[int]:
        """The leaders of the next vectors, which become leaders themselves if they have none."""
        own: list[int | None] = [None] * len(ids)
        if self.ids:
            near = m @ self.matrix[: len(self.ids)].T >= threshold
            own = [self.ids[k] if found else None for k, found in zip(near.argmax(axis=1).tolist(), near.any(axis=1).tolist(), strict=True)]
        rest = [i for i, x in enumerate(own) if x is None]
        near = m[rest] @ m[rest].T >= threshold
        for a, i in enumerate(rest):
            if own[i] is None:
                self.add(ids[i], m[i])
                for b in np.flatnonzero(near[a, a:]) + a:
                    if own[rest[b]] is None:
                        own[rest[b]] = ids[i]
        return own  # type: ignore[return-value]


def _lead(threshold: float, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    topic, leaders = None, _Leaders(1)
    for batch in batches:
        topics, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        m = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        m = m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + V.EPS)
        out: list[int] = []
        while len(out) < len(ids):
            at = len(out)
            if at == 0 and topic != topics[0] or topics[at] != topic:
                topic, leaders = topics[at], _Leaders(m.shape[1])
            end = at
            while end < min(len(ids), at + block) and topics[end] == topic:
                end += 1
            out += leaders.assign(ids[at:end], m[at:end], threshold)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["topic", "vec_id", "leader"])


def leader_merge(vectors: DataFrame, threshold: float = 0.85, block: int = 1024) -> DataFrame:
    """(topic, vec_id, leader): greedy leaders in the order of vec_id.

    A vector joins the first earlier leader with at least the threshold's cosine, or leads.  The
    assignment is sequential, so a topic's rows stream through one task, block by block; what is
    held is its leaders and a block.
    """
    rows = vectors.select("topic", F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return on_partitions(rows, "topic", "vec_id", _lead, "topic string, vec_id long, leader long", threshold, block)


def merged(chunks: DataFrame, leaders: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row a leader, the survivor's, with ``members``: how many rows it stands for.

    The survivor is the most confident one, the first on ties.  It gets the mean confidence, the
    united sources (sorted), the first time and, if it stands for several, its text rewritten.
    """
    columns = [c for c in chunks.columns if c != "topic"]
    rows = chunks.join(leaders.select("topic", key, "leader"), ["topic", key])
    best = F.max_by(F.struct(*columns), F.struct("confidence", -F.col("seq")))
    groups = rows.groupBy("topic", "leader").agg(
        best.alias("b"), F.avg("confidence").alias("mean"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_refs")))).alias("refs"), F.min("ts").alias("first"), F.count(F.lit(1)).alias("members")
    )
    own = {"confidence": F.col("mean"), "source_refs": F.col("refs"), "ts": F.col("first"), "text": F.when(F.col("members") > 1, X.make_absolute(F.col("b.text"))).otherwise(F.col("b.text"))}
    return groups.select("topic", "leader", "members", *(own.get(c, F.col(f"b.{c}")).alias(c) for c in columns))


def consolidate(chunks: DataFrame, most: int = 300, threshold: float = 0.85, key: str = "vec_id") -> DataFrame:
    """Resolve, prune, merge, rewrite, deduplicate and cap all topics in one plan.

    Chunks have topic, key, seq, text, confidence, staleness, entropy, ts, source_refs and
    embedding; the result has the columns of ``merged`` and ``rewritten``.
    """
    rows = prune(resolve_contradictions(chunks))
    if threshold < 1:
        rows = merged(rows, leader_merge(rows.select("topic", F.col(key).alias("vec_id"), "embedding"), threshold), key)
    else:
        rows = rows.withColumns({"leader": F.col(key), "members": F.lit(1).cast("long")})
    absolute = X.make_absolute(F.col("text"))
    rows = rows.withColumns({"rewritten": absolute != F.col("text"), "text": absolute})
    return cap(dedup(rows), most)


def consolidation_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(topic, before, after, removed, merged, absolute): merged and absolute of the chunks that are left."""
    n = before.groupBy("topic").agg(F.count(F.lit(1)).alias("before"))
    left = after.groupBy("topic").agg(F.count(F.lit(1)).alias("after"), F.sum(F.col("members") - 1).alias("merged"), F.count_if("rewritten").alias("absolute"))
    rows = n.join(left, "topic", "left").fillna(0, ["after", "merged", "absolute"])
    return rows.select("topic", "before", "after", (F.col("before") - F.col("after")).alias("removed"), "merged", "absolute")


def quality_of(chunks: DataFrame, topic: str, chunk_id: str) -> DataFrame:
    """One row: a chunk's quality; zeros if there is no such chunk."""
    found = chunks.where((F.col("topic") == topic) & (F.col("chunk_id") == chunk_id))
    q = X.quality(F.col("text"), F.col("confidence"), F.col("staleness"), F.col("verified"), F.col("quality"))
    scored = found.select(q.alias("q")).agg(F.first("q.overall").alias("overall"), F.first("q.specificity").alias("specificity"))
    return scored.select(F.coalesce("overall", F.lit(0.0)).alias("overall"), F.coalesce("specificity", F.lit(0.0)).alias("specificity"))


def forget(chunks: DataFrame, which: Column, floor: float = 0.01) -> DataFrame:
    """Chunks that count for next to nothing from now on, without being deleted."""
    return chunks.withColumns({c: F.when(which, floor).otherwise(F.col(c)) for c in ("confidence", "importance") if c in chunks.columns})


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; a change wins a tie."""
    both = base.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    return first_of_each(both, keys, [F.col(version).desc(), F.col("_change").desc()]).drop("_change")


def merge_topics(chunks: DataFrame, source: str, target: str) -> DataFrame:
    """chunks, and the source's texts that the target lacks as new chunks of the target."""
    rows = chunks.withColumn("_sha1", F.sha1("text"))
    new = rows.where(F.col("topic") == source).join(rows.where(F.col("topic") == target).select("_sha1").distinct(), "_sha1", "left_anti")
    new = first_of_each(new, ["_sha1"], [F.col("seq")]).withColumn("topic", F.lit(target)).drop("_sha1")
    return chunks.unionByName(new)


def split_topic(chunks: DataFrame, topic: str, moved: Column, new_topic: str) -> DataFrame:
    return chunks.withColumn("topic", F.when((F.col("topic") == topic) & moved, new_topic).otherwise(F.col("topic")))


def resolve_conflicts(local: DataFrame, remote: DataFrame, key: str, ts: str, policy: str = "latest") -> DataFrame:
    """One row a key: ``latest`` (remote only if newer), ``local_wins`` or ``source_wins``."""
    order = {"latest": [F.col(ts).desc(), F.col("_remote")], "local_wins": [F.col("_remote")], "source_wins": [F.col("_remote").desc()]}
    if policy not in order:
        raise ValueError(f"unknown policy {policy}")
    both = local.withColumn("_remote", F.lit(0)).unionByName(remote.withColumn("_remote", F.lit(1)))
    return first_of_each(both, [key], order[policy]).drop("_remote")
