"""Folds over the rows of each key in their order."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from engram.session import ship_package


def on_partitions(df: DataFrame, key: str, order: str, function: Callable[..., object], schema: str, *arguments: object) -> DataFrame:
    """A fold over the rows of each key in order, which keeps only the fold's own state.

    Keys are dealt out by a hash and sorted within a task, so a key's rows stream by and are never
    held together.  ``function(arguments, key batches)`` is a generator over Arrow batches.
    """
    ship_package(df.sparkSession)
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(partial(function, *arguments), schema)
