"""Multi-stage retrieval, keyword candidates with vector reranking, and explanations of scores."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from hashlib import md5
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import vectors as V
from engram.operators import search


def by_score(scored: DataFrame, k: int, score: str = "score", key: str = "vec_id") -> DataFrame:
    """The k best rows; ties by the largest key, as sorting pairs downwards has it."""
    return scored.orderBy(F.col(score).desc(), F.col(key).desc()).limit(k)


def find_memories(memories: DataFrame, limit: int, topic: str | None = None, agent: str | None = None, min_confidence: float | None = None, tags: Sequence[str] | None = None, key: str = "vec_id") -> DataFrame:
    """The newest memories that meet all conditions that are given; ties by key."""
    conditions = []
    if topic is not None:
        conditions.append(F.col("topic") == topic)
    if agent is not None:
        conditions.append(F.col("agent_id") == agent)
    if min_confidence is not None:
        conditions.append(F.col("confidence") >= min_confidence)
    if tags:
        conditions.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    for c in conditions:
        memories = memories.where(c)
    return memories.orderBy(F.col("ts").desc(), F.col(key)).limit(limit)


def like(text: Column, needle: str) -> Column:
    """Whether the text holds the needle, in any case; wildcards in it stand for themselves."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{escaped}%")


def text_search(memories: DataFrame, needle: str, limit: int, key: str = "vec_id") -> DataFrame:
    """Memories that hold the needle, the most confident first, all with score 0.5."""
    found = memories.where(like(F.col("text"), needle)).orderBy(F.col("confidence").desc(), F.col(key)).limit(limit)
    return found.withColumn("score", F.lit(0.5))


def search_among(vectors: DataFrame, query: Sequence[float], k: int, ids: DataFrame, post_filter: bool = False, key: str = "vec_id") -> DataFrame:
    """The k best of the allowed ids; with post_filter the allowed ones of the 2k best, at most k."""
    if post_filter:
        best = search.exact(vectors, query, 2 * k).join(F.broadcast(ids.select(key).distinct()), key, "left_semi")
        return search.topk(best, k, key=key)
    return search.exact(vectors.join(ids.select(key), key, "left_semi"), query, k)


def multistage(memories: DataFrame, query: Sequence[float], k: int, topics: int = 20, newest: int = 100, where: Column | None = None, stages: Sequence[str] = ("centroid", "ann", "exact"), key: str = "vec_id") -> DataFrame:
    """Stages that narrow down the candidates; the last one's inner product is the score.

    centroid: the newest memories of the topics whose centroids fit best.  ann: the 4k best of
    all are candidates, too.  exact: the 2k best of the candidates.  The filter comes last, so
    fewer than k may be left.
    """
    unknown = set(stages) - {"centroid", "ann", "exact"}
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    scored = memories.withColumn("score", V.dot(V.as_double("embedding"), search.literal_vector(query)))
    found = scored
    if "centroid" in stages:
        chosen = search.prefilter(memories, query, topics, V.dot).select("topic")
        rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("ts").desc(), key))
        found = scored.join(F.broadcast(chosen), "topic", "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= newest).drop("_rank")
    if "ann" in stages:
        best = by_score(scored, 4 * k, key=key)
        found = found.unionByName(best).dropDuplicates([key]) if "centroid" in stages else best
    if "exact" in stages:
        found = by_score(found, 2 * k, key=key)
    return by_score(found if where is None else found.where(where), k, key=key)


def overlap_fusion(vector: DataFrame, keyword: DataFrame, k: int, weight: float = 0.7, key: str = "vec_id") -> DataFrame:
    """What both lists have weighs vector * (1 - weight) + keyword * weight, the rest as it is."""
    rows = vector.select(key, F.col("score").alias("v")).join(keyword.select(key, F.col("score").alias("w")), key, "full")
    score = F.when(F.col("v").isNull(), F.col("w")).when(F.col("w").isNull(), F.col("v")).otherwise(F.col("v") * (1 - weight) + F.col("w") * weight)
    return search.topk(rows.select(key, score.alias("score")), k, key=key)


def keyword_then_vector(memories: DataFrame, terms: Sequence[str], query: Sequence[float], k: int, candidates: int = 200, where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The best keyword matches, those that meet the condition, by cosine."""
    found = search.topk(search.bm25(memories, terms, key=key), candidates, key=key).select(key)
    rows = memories.join(F.broadcast(found), key, "left_semi")  # at most ``candidates`` rows
    rows = rows if where is None else rows.where(where)
    return search.exact(rows, query, k)


def explain_scores(fused: DataFrame, weights: dict[str, float], key: str = "doc_id") -> DataFrame:
    """For each signal of weighted fusion its score, weight and contribution, to 4 places (half to even)."""

    def part(name: str) -> Column:
        contribution = F.col(name)
        score = F.try_divide(contribution, F.lit(weights[name])) if weights[name] else F.lit(0.0)
        return F.struct(F.bround(score, 4).alias("score"), F.lit(weights[name]).alias("weight"), F.bround(contribution, 4).alias("contribution"))

    return fused.select(key, F.bround("score", 4).alias("final_score"), *(part(n).alias(n) for n in weights))


def explanation(explained: DataFrame, weights: dict[str, float], key: str = "doc_id") -> DataFrame:
    """(key, text): the explanation as a line to read."""
    parts = [F.format_string(f"{n}: %.4f x %.2f = %.4f", F.col(n)["score"], F.col(n)["weight"], F.col(n)["contribution"]) for n in weights]
    return explained.select(key, F.concat(F.format_string("score %.4f; ", "final_score"), F.concat_ws("; ", *parts)).alias("text"))


def query_plan(df: DataFrame) -> str:
    """The plan that Spark will run, as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def relevant_terms(docs: DataFrame, terms: Sequence[str], limit: int, analyzer: search.Analyzer = search.ANALYZED) -> DataFrame:
    """(term, idf): the query's terms that some document has, the rarest first."""
    listed = list(dict.fromkeys(terms))
    rows = search.frequencies(docs, listed, analyzer)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(listed))))
    each = counts.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df{i}").alias("df")) for i, t in enumerate(listed)])).alias("x"))
    idf = F.log((F.col("n") - F.col("x.df") + 0.5) / (F.col("x.df") + 0.5) + 1)
    return each.where(F.col("x.df") > 0).select("x.term", idf.alias("idf")).orderBy(F.col("idf").desc(), "term").limit(limit)


def hits_with_metadata(hits: DataFrame, metadata: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits of an index with what the store knows of them; unknown ids go."""
    return metadata.join(F.broadcast(hits), key)  # a top-k is small


FUSIONS: dict[str, Callable[..., DataFrame]] = {"rrf": search.rrf, "linear": search.linear_fusion, "weighted": search.weighted_fusion, "overlap": overlap_fusion}


def fuse(method: str, *args: Any, **options: Any) -> DataFrame:
    """A fusion by its name; late interaction is declared nowhere but in name, and so is refused."""
    if method not in FUSIONS:
        raise ValueError(f"unknown fusion {method}")
    return FUSIONS[method](*args, **options)


class ResultCache:
    """The rows of recent queries, least recently used first to go; a cache never changes results."""

    def __init__(self, size: int = 128) -> None:
        self.size, self.hits, self.misses = size, 0, 0
        self._rows: OrderedDict[str, list] = OrderedDict()

    @staticmethod
    def key(name: str, **parameters: Any) -> str:
        return md5(repr((name, sorted(parameters.items()))).encode(), usedforsecurity=False).hexdigest()

    def rows(self, key: str, query: Callable[[], DataFrame]) -> list:
        """The query's rows, which are few (a top-k)."""
        if key in self._rows:
            self.hits += 1
            self._rows.move_to_end(key)
        else:
            self.misses += 1
            self._rows[key] = query().collect()
            while len(self._rows) > self.size:
                self._rows.popitem(last=False)
        return self._rows[key]

    def statistics(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self._rows), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}

    def forget(self) -> None:
        self._rows.clear()
