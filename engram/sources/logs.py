"""Logs and side tables of a store: audit, consolidation, access, edges, segments, vectors, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each version of the chunk table, with what an older table's rows get.
MIGRATIONS: tuple[tuple[int, dict[str, object]], ...] = (
    (1, {"confidence": 0.5, "staleness": 0.0}),
    (2, {"quality": 0.5, "verified": False, "entropy": 0.0}),
    (3, {"importance": 0.5, "source": None}),
)


def audit_rows(rows: DataFrame, operation: str, as_of: Column, *details: str) -> DataFrame:
    """(ts, operation, topic, details) for rows that an operation touched; details is JSON."""
    return rows.select(as_of.alias("ts"), F.lit(operation).alias("operation"), "topic", F.to_json(F.struct(*details)).alias("details"))


def latest_logs(log: DataFrame, limit: int, operation: str | None = None) -> DataFrame:
    rows = log if operation is None else log.where(F.col("operation") == operation)
    return rows.orderBy(F.col("ts").desc(), "topic", "details").limit(limit)


def access_counts(accesses: DataFrame, key: str) -> DataFrame:
    """(key, accesses, last): how often each memory was read, and when last."""
    return accesses.groupBy(key).agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last"))


def edges_of(edges: DataFrame, node: int, kind: str | None = None) -> DataFrame:
    """Edges at a node, seen from it: (other, kind); an edge has no direction."""
    rows = edges if kind is None else edges.where(F.col("kind") == kind)
    rows = rows.where((F.col("a") == node) | (F.col("b") == node))
    return rows.select(F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")).alias("other"), "kind").distinct()


def write_segments(chunks: DataFrame, path: str, segments: int) -> None:
    """Cold rows in files of ranges of time, so that their minima and maxima prune reads."""
    chunks.repartitionByRange(segments, "ts").sortWithinPartitions("ts").write.mode("append").option("compression", "zstd").parquet(path)


def compact_segments(spark: SparkSession, path: str, target: str, segments: int, key: str = "vec_id") -> DataFrame:
    """All segments as ``segments`` new ones; of rows with one key the newest stays."""
    rows = spark.read.parquet(path)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "ts").alias("r")).select(key, "r.*")
    write_segments(best, target, segments)
    return spark.read.parquet(target)


def zone_maps(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, least, most): what each segment's rows span."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "ts")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("least"), F.max("ts").alias("most"))


def vector_store_statistics(packed: DataFrame) -> DataFrame:
    """Rows, bytes, and how much smaller packed vectors are than floats."""
    size = F.sum(F.octet_length("data").cast("long"))
    return packed.agg(F.count(F.lit(1)).alias("vectors"), size.alias("bytes"), (F.sum(F.col("dim") * 4) / size).alias("ratio"))


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def migrate(df: DataFrame, version: int, target: int = MIGRATIONS[-1][0]) -> DataFrame:
    """df of an older version with the columns of the target version."""
    for number, columns in MIGRATIONS:
        if version < number <= target:
            df = df.withColumns({c: F.lit(v) if v is not None else F.lit(None).cast("string") for c, v in columns.items() if c not in df.columns})
    return df


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, json): the rows of each report as one JSON array, in their own order of text."""
    out: DataFrame | None = None
    for name, df in parts.items():
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("row"))
        one = rows.agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("rows")).select(F.lit(name).alias("part"), F.concat(F.lit("["), "rows", F.lit("]")).alias("json"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no reports")
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def last_version(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("version"))
