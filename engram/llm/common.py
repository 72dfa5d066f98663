"""What the operators of this subpackage share: scratch tables, Arrow plumbing, running sums."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.session import ship_package

#: The columns of ``documents``.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a batch of rows that goes to Python or comes back from there.
ARROW_BYTES = 4 << 20
#: Bits of a filter for each hash in it, and of a filter at least and at most.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 24

_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (a local session, as in tests) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = getattr(spark.sparkContext, "_engram_scratch", None) or tempfile.mkdtemp(prefix="engram-scratch-")
        spark.sparkContext._engram_scratch = named  # type: ignore[attr-defined]
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    The plan that follows no longer depends on df's, and a lost executor costs no recomputation
    of what was written.
    """
    path = f"{scratch_dir(df.sparkSession)}/engram-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote and that no plan reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Has the session cut Arrow batches by bytes, as 10,000 long rows are more than a worker should hold."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(ARROW_BYTES))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def quoted(name: str) -> str:
    """A column's name as it is, with dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, hint: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while hint.lower() in taken:
        hint += "_"
    return hint


def with_results(df: DataFrame, function: Callable[[pa.Array], list[list]], text: Column, schema: pa.Schema, limit: int, into: str | None = None) -> DataFrame:
    """df with the columns of schema, which replace those of these names; or as one struct ``into``.

    ``function`` gets pieces of the text column of at most ``limit`` bytes (or one text) and
    returns a list for each new column.  Only the texts go to Python and only the results come
    back; the rows wait in the JVM, which spills them.
    """
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    @F.arrow_udf(", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in schema))
    def results(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for piece in pieces(iter([pa.RecordBatch.from_arrays([batch], names=["text"])]), "text", limit):
                columns = function(piece.column(0))
                found.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], fields=list(schema)))
            yield pa.concat_arrays(found) if found else pa.array([], pa.struct(list(schema)))

    # as if it were not deterministic, so that no filter on its results has it run twice
    found = results.asNondeterministic()(text)
    if into:
        return df.select("*", found.alias(into))
    into, kept = free_name(df, "_results"), [c for c in df.columns if c not in schema.names]
    rows = df.select(*[df[quoted(c)] for c in kept], found.alias(into))
    return rows.select(*map(quoted, kept), *(F.col(into)[name].alias(name) for name in schema.names))


_SQL_TYPES = {pa.string(): "string", pa.float64(): "double", pa.int64(): "long", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that none holds more than about ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        at, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def key_filter(written: DataFrame, key: str) -> tuple[int, np.ndarray]:
    """The number of rows of a table of hashes, and a set of bits by the hashes' last bits.

    What isn't in the set isn't in the table.  The set has FILTER_BITS for each row, within bounds
    whatever the table's size, so it lets the more through the larger the table is.
    """
    n = written.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * n).bit_length()))
    at = F.col(key).bitwiseAND(size - 1)
    rows = written.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return n, bits


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows of the group that come before.

    The order begins with a 64-bit hash (``order[0]``, a long).  A group is never gathered in one
    task: it is cut into 1024 ranges of the hash, the ranges' sums are added up (1024 rows a
    group), and only a range is put in order by one task.
    """
    keys = [*group, "_range"]
    parted = df.withColumn("_range", F.shiftright(order[0], 54).cast("int")).withColumn("_value", value)
    sums = parted.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys).orderBy(*order[0:]).rowsBetween(Window.unboundedPreceding, -1)
    own = parted.withColumn("_own", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return own.join(sums, keys).withColumn(into, F.col("_base") + F.col("_own")).drop("_range", "_value", "_base", "_own")
