"""Folds in order: recent-duplicate windows, scene changes, moving centroids, periodic maintenance, synchronisation."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import vectors as V
from engram.operators.ordered import on_partitions
from engram.session import ship_package


_BITS = (1 << 64) - 1


def hamming(a: Column, b: Column) -> Column:
    """How many bits two 64-bit hashes differ in."""
    return F.bit_count(a.bitwiseXOR(b))


def _recent(window: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, kept = None, deque(maxlen=window)
    for batch in batches:
        keep = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != group:
                group, kept = key, deque(maxlen=window)
            new = value is None or all(((value ^ x) & _BITS).bit_count() > most for x in kept)
            if new and value is not None:
                kept.append(value)
            keep.append(new)
        yield batch.filter(pa.array(keep, pa.bool_()))


def drop_recent_duplicates(frames: DataFrame, key: str, order: str, value: str, window: int = 300, distance: int = 6) -> DataFrame:
    """(key, order, value) of rows whose hash differs in over ``distance`` bits from the last ``window`` kept ones of their key.

    A null hash is kept and not remembered.
    """
    rows = frames.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    found = on_partitions(rows, "k", "o", _recent, f"k {kinds[0]}, o {kinds[1]}, v {kinds[2]}", window, distance)
    return found.select(F.col("k").alias(key), F.col("o").alias(order), F.col("v").alias(value))


def _changes(threshold: float, step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, last, n = None, None, 0
    for batch in batches:
        keep = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != group:
                group, last, n = key, None, 0
            change = n % step == 0 and value is not None and (last is None or abs(value - last) > threshold)
            last = value if change else last
            n += 1
            keep.append(change)
        yield batch.filter(pa.array(keep, pa.bool_()))


def scene_changes(frames: DataFrame, key: str, order: str, value: str, threshold: float, step: int = 1) -> DataFrame:
    """(key, order, value) of every step-th row that differs by over the threshold from the last one kept."""
    rows = frames.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    found = on_partitions(rows, "k", "o", _changes, f"k {kinds[0]}, o {kinds[1]}, v double", threshold, step)
    return found.select(F.col("k").alias(key), F.col("o").alias(order), F.col("v").alias(value))


def moving_centroids(vectors: DataFrame, order: str, alpha: float = 0.05, topic: str = "topic") -> DataFrame:
    """(topic, pos, value): the mean that each vector in order moves by alpha.

    The fold has a closed form: of n vectors the first weighs (1 - alpha)^(n - 1), and the i-th
    after it alpha * (1 - alpha)^(n - i).  So it is a weighted sum.
    """
    back = F.row_number().over(Window.partitionBy(topic).orderBy(F.col(order).desc())) - 1
    first = F.lead(order).over(Window.partitionBy(topic).orderBy(F.col(order).desc())).isNull()
    ranked = vectors.select(topic, V.as_double("embedding").alias("e"), back.alias("back"), first.alias("first"))
    weight = F.pow(F.lit(1 - alpha), "back") * F.when(F.col("first"), 1.0).otherwise(alpha)
    return ranked.withColumn("w", weight).select(topic, "w", F.posexplode("e").alias("pos", "x")).groupBy(topic, "pos").agg(F.sum(F.col("w") * F.col("x")).alias("value"))


def pull(events: DataFrame, after: int, upto: int | None = None, topics: list | None = None, topic: str = "topic") -> DataFrame:
    """The events after the high-water mark, up to an id, of some topics if they are named."""
    rows = events.where(F.col("event_id") > after)
    rows = rows if upto is None else rows.where(F.col("event_id") <= upto)
    return rows if topics is None else rows.where(F.col(topic).isin(topics))


def high_water(marks: DataFrame, remote: str) -> int:
    """The largest event id that was taken from a remote; 0 before the first."""
    return marks.where(F.col("remote") == remote).agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]


def synchronise(local: DataFrame, remote: DataFrame, marks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The local log with what the remote has after its mark, and the marks with the new one.

    Events are known by (origin, event_id), so an event that comes twice changes nothing.
    """
    new = pull(remote, high_water(marks, name))
    merged = local.unionByName(new).dropDuplicates(["origin", "event_id"])
    mark = new.agg(F.max("event_id").alias("event_id")).where(F.col("event_id").isNotNull()).select(F.lit(name).alias("remote"), "event_id")
    return merged, marks.unionByName(mark)


def replay_counted(events: DataFrame, handler: Callable[[str], None], column: str) -> DataFrame:
    """(status, n): how many rows the handler took, and how many it failed on and were skipped."""
    ship_package(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = failed = 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                try:
                    handler(value)
                    done += 1
                except Exception:  # noqa: BLE001 - a handler may fail in any way; failures are counted
                    failed += 1
        yield pa.RecordBatch.from_arrays([pa.array(["done", "failed"]), pa.array([done, failed])], names=["status", "n"])

    return events.select(column).mapInArrow(run, "status string, n long").groupBy("status").agg(F.sum("n").alias("n"))


def hot_stream(events: DataFrame, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, key, hits) of a stream of accesses."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("hits"))
    return rows.select(F.col("w.start").alias("window_start"), key, "hits")


def periodically(stream: DataFrame, job: Callable[[DataFrame], None], checkpoint: str, every: str | None = None):
    """Runs a maintenance job on each micro-batch, every so often; without ``every`` once, over what there is."""

    def run(batch: DataFrame, _: int) -> None:
        job(batch)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_folder(spark: SparkSession, folder: str, done: str | None = None) -> DataFrame:
    """(path, text) of text files as they come into a folder; read ones may go to another."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
