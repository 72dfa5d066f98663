"""Session helpers: a configured session, and the package itself for remote executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent
#: A narrow table of so many rows is broadcast.
FEW = 1 << 19


def session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "engram", **conf: str) -> SparkSession:
    """A session with the settings that the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a context, so that workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_engram_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="engram-")) / "engram.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, path.relative_to(_ROOT.parent).as_posix())
    context.addPyFile(str(target))
    context._engram_shipped = True  # type: ignore[attr-defined]


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer splits than that.

    A small table is one split, and so one task, however much work a row makes.  A table with as
    many splits as cores is left as it is, so that a large one is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def few(df: DataFrame) -> DataFrame:
    """df, a narrow table as it is read, to be broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= FEW else df


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, for what a query writes.

    It lies in the folder that ``spark.checkpoint.dir`` names; only where that is unset, in a local
    session, a temporary one takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{named.rstrip('/')}/engram-{name}-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix=f"engram-{name}-")
