"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import discard, materialise


def _with_least(arcs: DataFrame) -> DataFrame:
    """(u, v, m): arcs with the least of u's neighbours and u itself."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(arcs).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    stars = _with_least(edges)
    moved = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node has one root at most, and no root has one."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e")
    nodes = edges.select(ends).groupBy("e.node").agg(F.sum("e.below").alias("below"), F.max("e.above").alias("above"))
    return nodes.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component.

    Every round is written to the shared folder, so a round is never computed twice, and the round
    before is deleted.  Nodes are of one orderable type; links from a node to itself count for
    nothing.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    while not _settled(edges):
        before, edges = edges, materialise(_small_star(_large_star(edges)), "links")
        discard(before)
    roots = materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    discard(edges)
    return roots
