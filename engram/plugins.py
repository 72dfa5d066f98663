"""Extension points: scorers, embedders, verifiers and stores by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import vectors as V

#: What a plugin of each kind is: a function of columns, of a text column, or of DataFrames.
Scorer = Callable[..., Column]
Embedder = Callable[[Column], Column]
Verifier = Callable[[DataFrame, DataFrame], DataFrame]

KINDS = ("scorer", "embedder", "verifier", "store")


class Plugin:
    """What a plugin may be besides a function: something with a beginning and an end."""

    def initialize(self, **settings: Any) -> None:
        self.settings = settings

    def cleanup(self) -> None:
        self.settings = {}


class ParquetStore(Plugin):
    """A store of rows with a key: a folder of Parquet files, rewritten by topic."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def save(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(self.path)

    def without(self, keys: DataFrame) -> DataFrame:
        return self.load().join(keys.select(self.key), self.key, "left_anti")

    def search(self, query: list[float], k: int) -> DataFrame:
        scored = self.load().withColumn("score", V.cosine(V.as_double("embedding"), F.array(*map(F.lit, query))))
        return scored.orderBy(F.col("score").desc(), self.key).limit(k)


class Registry:
    def __init__(self) -> None:
        self._found: dict[str, dict[str, Any]] = {k: {} for k in KINDS}

    def add(self, kind: str, name: str, plugin: Any, **settings: Any) -> None:
        if kind not in self._found:
            raise ValueError(f"unknown kind of plugin {kind}")
        if isinstance(plugin, Plugin):
            plugin.initialize(**settings)
        self._found[kind][name] = plugin

    def get(self, kind: str, name: str) -> Any:
        return self._found[kind][name]

    def names(self, kind: str) -> list[str]:
        return sorted(self._found[kind])

    def remove(self, kind: str, name: str) -> None:
        plugin = self._found[kind].pop(name, None)
        if isinstance(plugin, Plugin):
            plugin.cleanup()

    def load(self, kind: str, name: str, module: str, attribute: str) -> Any:
        """Adds what a module has by that name."""
        plugin = getattr(importlib.import_module(module), attribute)
        self.add(kind, name, plugin)
        return plugin

    def load_installed(self, group: str = "engram.plugins") -> list[str]:
        """Adds the entry points of installed packages; their names are ``kind:name``."""
        found = []
        for point in entry_points(group=group):
            kind, _, name = point.name.partition(":")
            self.add(kind, name, point.load())
            found.append(point.name)
        return found

    def set_embedder(self, embedder: Embedder) -> None:
        self.add("embedder", "default", embedder)

    def embedder(self) -> Embedder:
        """The one that was set, or hashed words."""
        return self._found["embedder"].get("default", V.embed_hashed)


registry = Registry()
