"""The event log in batch and as a stream: replay, folding, windows, replication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def since(events: DataFrame, ts: Column) -> DataFrame:
    return events.where(F.col("ts") >= ts)


def after(events: DataFrame, ts: Column) -> DataFrame:
    """Strictly later events."""
    return events.where(F.col("ts") > ts)


def by_topic(events: DataFrame, column: str, value) -> DataFrame:
    return events.where(F.col(column) == value)


def log_statistics(events: DataFrame) -> DataFrame:
    """One row: how many events, of how many kinds, the first and last id and time."""
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_type").alias("kinds"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.max("ts").alias("last_ts"))


def export_log(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def import_log(spark: SparkSession, path: str, local: DataFrame) -> DataFrame:
    """The local log with an exported one's events, each once."""
    return replicate(local, spark.read.schema(local.schema).json(path))


def id_range(events: DataFrame, start: int, end: int) -> DataFrame:
    return events.where((F.col("event_id") >= start) & (F.col("event_id") < end))


def truncate(events: DataFrame, keep_from: int) -> DataFrame:
    return events.where(F.col("event_id") >= keep_from)


def fold(events: DataFrame, key: str, deleted: str) -> DataFrame:
    """The state that the log describes: each key's last event, unless it deletes."""
    last = events.groupBy(key).agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("last"))
    return last.select(key, "last.*").where(F.col("event_type") != deleted)


def replicate(local: DataFrame, remote: DataFrame, origin: str = "origin", key: str = "event_id") -> DataFrame:
    """The union of two logs, each event of an origin once: pulling again changes nothing."""
    return local.unionByName(remote).dropDuplicates([origin, key])


def windows(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; with a watermark if it is a stream."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into Parquet, and reads that."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    else:
        def save(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(path)

        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def replay(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch to the handler; the checkpoint is the high-water mark."""
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
