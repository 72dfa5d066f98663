"""Reports over chunks and event logs: one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _avg(name: str) -> Column:
    return F.coalesce(F.avg(name), F.lit(0.0))


def store_metrics(chunks: DataFrame, as_of: Column) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_distinct("topic").alias("total_topics"),
        _avg("confidence").alias("avg_confidence"),
        _avg("staleness").alias("avg_staleness"),
        _avg("quality").alias("avg_quality"),
        F.count_if(F.col("ttl_ts") < as_of).alias("expired"),
        F.count_if(F.col("staleness") > 0.5).alias("contradicted"),
        F.count_if("verified").alias("verified"),
    )


def maintenance_metrics(log: DataFrame) -> DataFrame:
    """One row of (ts, action, topic, chunks_affected) rows: the last consolidation, and how many chunks were pruned."""
    pruned = F.sum(F.when(F.col("action") == "prune", F.col("chunks_affected")))
    return log.agg(F.max(F.when(F.col("action") == "consolidate", F.col("ts"))).alias("last_consolidation"), F.coalesce(pruned, F.lit(0)).alias("pruned"))


def topic_health(chunks: DataFrame) -> DataFrame:
    health = 0.4 * _avg("confidence") + 0.3 * (1 - _avg("staleness")) + 0.3 * _avg("quality")
    return chunks.groupBy("topic").agg(F.count(F.lit(1)).alias("chunks"), health.alias("health"))


def topic_stats(chunks: DataFrame) -> DataFrame:
    """Sizes and confidences of topics, and of all (topic null)."""
    return chunks.rollup("topic").agg(F.count(F.lit(1)).alias("chunks"), F.avg("confidence").alias("avg_confidence"))


def retention(chunks: DataFrame) -> DataFrame:
    stale = F.count_if(F.col("staleness") > 0.7)
    rate = 1 - stale / F.count(F.lit(1))
    level = F.when(rate > 0.8, "high").when(rate < 0.5, "low").otherwise("medium")
    return chunks.groupBy("topic").agg(F.count(F.lit(1)).alias("chunks"), stale.alias("stale"), rate.alias("retention"), level.alias("level"))


def hot(events: DataFrame, key: str, n: int, least: int = 1) -> DataFrame:
    """The n most frequent keys; ties by key."""
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    return counts.orderBy(F.col("hits").desc(), key).limit(n)


def percentiles(df: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """p50, p95 and p99 by linear interpolation."""
    grouped = df.groupBy(key) if key else df.groupBy()
    return grouped.agg(*(F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)))


def index_statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, topics, mean confidence, and how many have no topic."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("topic").alias("topics"), _avg("confidence").alias("avg_confidence"), F.count_if(F.col("topic").isNull()).alias("without_topic"))


def memory_statistics(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: memories, mean confidence and importance, topics, and edges that contradict."""
    rows = memories.agg(F.count(F.lit(1)).alias("memories"), _avg("confidence").alias("avg_confidence"), _avg("importance").alias("avg_importance"), F.count_distinct("topic").alias("topics"))
    return rows.crossJoin(F.broadcast(edges.agg(F.count_if(F.col("kind") == "contradicts").alias("contradictions"))))


def fidelity(pairs: DataFrame, value: str) -> DataFrame:
    """One row: mean, least, largest and population deviation."""
    return pairs.agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(value).alias("deviation"))
