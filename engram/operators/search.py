"""Retrieval: exact and pruned vector search, BM25, rank fusion, verification.

Query vectors, centroids and query terms are the only things that are broadcast; the functions
take one query (or a bounded list of terms) and say so.  Batches of queries go through
``batch_topk``, which broadcasts them in parts of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import vectors as V
from engram.session import ship_package


#: Dimensions of a vector that are averaged as columns.
COLUMNS = 128
#: Topics among which assign_topic chooses, at most.
CENTROIDS = 1 << 14
#: Queries of at most this many bytes are broadcast together.
BROADCAST_BYTES = 32 << 20


def literal_vector(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def topk(scored: DataFrame, k: int, score: str = "score", key: str = "vec_id", ascending: bool = False) -> DataFrame:
    """The k best rows; ties by key."""
    return scored.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), F.col(key)).limit(k)


def exact(vectors: DataFrame, query: Sequence[float], k: int, similarity: Callable[[Column, Column], Column] = V.cosine, ascending: bool = False) -> DataFrame:
    """Every vector against one query vector; one exchange of k rows a task."""
    scored = vectors.withColumn("score", similarity(V.as_double("embedding"), literal_vector(query)))
    return topk(scored, k, ascending=ascending)


def batch_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of largest cosine for each query but itself.

    Every batch of vectors is multiplied with a matrix of queries; a task keeps the k best of each
    query among all its vectors, so what is merged is k rows for a query and task.  Queries are
    broadcast in parts of at most BROADCAST_BYTES, with one pass over the vectors for each part.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    fitting = max(1, BROADCAST_BYTES // max(1, 4 * dim + 16))
    parts = max(1, -(-n // fitting))
    found = None
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        table = own.toArrow()
        if not table.num_rows:
            continue
        matrix = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["embedding"].chunks]).reshape(-1, dim).astype(np.float32)
        held = spark.sparkContext.broadcast((table["query_id"].to_numpy(), matrix))
        best = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(partial(_best_of, held, dim, k, block), "query_id long, vec_id long, score double")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(n < V.EPS, 0.0, m / (n + V.EPS))


def _best_of(held: Any, dim: int, k: int, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best of a task's vectors for each query, block by block."""
    q_ids, matrix = held.value
    q = _unit(matrix)
    ids, scores = np.full((len(q), 0), 0, np.int64), np.zeros((len(q), 0))
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            own = part.column(0).to_numpy()
            v = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            s = q @ v.T
            s[q_ids[:, None] == own[None, :]] = -2.0
            ids = np.concatenate([ids, np.broadcast_to(own, s.shape)], axis=1)
            scores = np.concatenate([scores, s], axis=1)
            order = np.lexsort((ids, -np.round(scores, 9)), axis=1)[:, :k]
            ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
    keep = scores.ravel() > -2.0
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, ids.shape[1])[keep]), pa.array(ids.ravel()[keep]), pa.array(scores.ravel()[keep])], names=["query_id", "vec_id", "score"])


def centroids(vectors: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, pos, value): element-wise means, pre-aggregated before the shuffle."""
    return vectors.select(topic, F.posexplode(V.as_double("embedding")).alias("pos", "x")).groupBy(topic, "pos").agg(F.avg("x").alias("value"))


def centroid_vectors(vectors: DataFrame, topic: str = "topic", dim: int | None = None) -> DataFrame:
    """(topic, centroid); a small dimension that is known is averaged place by place, without a row for each."""
    if dim and dim <= COLUMNS:
        return vectors.groupBy(topic).agg(F.array(*[F.avg(F.get("embedding", i).cast("double")) for i in range(dim)]).alias("centroid"))
    listed = centroids(vectors, topic).groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return listed.select(topic, F.transform("p", lambda p: p["value"]).alias("centroid"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def assign_topic(vectors: DataFrame, centroids_: DataFrame, topic: str = "topic", centroid: str = "centroid") -> DataFrame:
    """vectors with ``assigned``: the topic of the largest inner product, ties to the first by name.

    Centroids are collected up to CENTROIDS of them; a larger table is refused, as that is no
    small set of topics any more.
    """
    listed = sorted((r["t"], r["c"]) for r in centroids_.select(F.col(topic).alias("t"), F.col(centroid).alias("c")).limit(CENTROIDS + 1).collect())
    if len(listed) > CENTROIDS:
        raise ValueError(f"more than {CENTROIDS} centroids")
    if not listed:
        return vectors.withColumn("assigned", F.lit(None).cast("string"))
    ship_package(vectors.sparkSession)
    names, c = pa.array([t for t, _ in listed]), np.array([c for _, c in listed], np.float64)

    @F.arrow_udf("string")
    def best(embedding: pa.Array) -> pa.Array:
        return names.take(pa.array(np.round(_matrix(embedding, c.shape[1]) @ c.T, 9).argmax(axis=1)))

    return vectors.withColumn("assigned", best("embedding"))


def prefilter(vectors: DataFrame, query: Sequence[float], topics: int, similarity: Callable[[Column, Column], Column] = V.cosine) -> DataFrame:
    """(topic, score): the topics whose centroids are most similar to the query."""
    scored = centroid_vectors(vectors, dim=len(query)).select("topic", similarity(F.col("centroid"), literal_vector(query)).alias("score"))
    return topk(scored, topics, key="topic")


def memory_score(similarity: Column) -> Column:
    """Similarity weighted by confidence, staleness and quality."""
    return similarity * (0.5 + F.col("confidence")) * (1 - 0.5 * F.col("staleness")) * (0.5 + 0.5 * F.col("quality"))


def memory_query(chunks: DataFrame, query: Sequence[float], k: int = 5, topics: int = 5, where: Column | None = None) -> DataFrame:
    """The main query: topics by centroid, filters, weighted similarity, k best.

    The filters stand before the scoring, so they reach the scan.
    """
    chosen = F.broadcast(prefilter(chunks, query, topics).select("topic"))  # at most ``topics`` rows
    rows = chunks.where(where) if where is not None else chunks
    rows = rows.join(chosen, "topic", "left_semi")
    return topk(rows.withColumn("score", memory_score(V.cosine(V.as_double("embedding"), literal_vector(query)))), k)


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes tokens: the tokens, their number, and how often a term is among them."""

    tokens: Callable[[Column], Column]
    length: Callable[[Column], Column]
    frequency: Callable[[Column, str], Column]


ANALYZED = Analyzer(X.analyze, X.n_analyzed, X.analyzed_frequency)
SPACED = Analyzer(X.words_lower, X.n_words, X.word_frequency)


def frequencies(docs: DataFrame, query: Sequence[str], analyzer: Analyzer = ANALYZED, key: str = "doc_id") -> DataFrame:
    """(key, len, tf0, tf1 ...): the length of each document, and each distinct term's frequency.

    The texts are read once and only numbers go on; they are kept, as statistics and scores both
    need them.
    """
    terms = list(dict.fromkeys(query))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(key, analyzer.length(text).alias("len"), *(analyzer.frequency(text, t).alias(f"tf{i}") for i, t in enumerate(terms)))
    return rows.persist()


def bm25(docs: DataFrame, query: Sequence[str], analyzer: Analyzer = ANALYZED, k1: float = 1.5, b: float = 0.75, keep_zero: bool = False, key: str = "doc_id") -> DataFrame:
    """(doc_id, score) for a query of a few terms, repeated terms counting repeatedly."""
    terms = list(dict.fromkeys(query))
    rows = frequencies(docs, query, analyzer, key)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.avg("len")).alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + query.count(q) * idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    scored = joined.select(key, score.alias("score"))
    return scored if keep_zero else scored.where(F.col("score") > 0)


def only(scored: DataFrame, allowed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores of the allowed documents, as the whole corpus gives them."""
    return scored.join(allowed.select(key), key, "left_semi")


def term_frequencies(docs: DataFrame, analyzer: Analyzer = ANALYZED, key: str = "doc_id") -> DataFrame:
    """(key, term, tf): how often each document has each of its terms."""
    return docs.select(key, F.explode(analyzer.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def index_statistics(docs: DataFrame, analyzer: Analyzer = ANALYZED) -> DataFrame:
    """One row: documents, mean length, distinct terms."""
    text = F.coalesce("text", F.lit(""))
    sizes = docs.agg(F.count(F.lit(1)).alias("doc_count"), F.avg(analyzer.length(text)).alias("avg_doc_len"))
    return sizes.crossJoin(F.broadcast(term_statistics(docs, analyzer.tokens).agg(F.count(F.lit(1)).alias("unique_terms"))))


def term_statistics(docs: DataFrame, analyzer: Callable[[Column], Column] = X.analyze) -> DataFrame:
    """(term, df, idf) of a corpus."""
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))
    df = docs.select(F.explode(F.array_distinct(analyzer(F.coalesce("text", F.lit(""))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(n).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def ranked(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best with their rank from 0.  Only k rows are numbered."""
    best = topk(scored, k, key=key)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key))) - 1)


def rrf(lists: Sequence[DataFrame], depth: int, constant: int = 60, key: str = "doc_id", min_score: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of the first ``depth`` of each list; lower scores than min_score go."""
    parts = [ranked(x, depth, key).select(key, (F.lit(1.0) / (constant + F.col("rank"))).alias("part")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fused = out.groupBy(key).agg(F.sum("part").alias("score"))
    return fused.where(F.col("score") >= min_score) if min_score else fused


def linear_fusion(keyword: DataFrame, vector: DataFrame, alpha: float = 0.5, key: str = "doc_id") -> DataFrame:
    """alpha * keyword + (1 - alpha) * vector, with where a row came from."""
    joined = keyword.select(key, F.col("score").alias("k")).join(vector.select(key, F.col("score").alias("v")), key, "full")
    source = F.when(F.col("v").isNull(), "bm25").when(F.col("k").isNull(), "vector").otherwise("hybrid")
    return joined.select(key, (alpha * F.coalesce("k", F.lit(0.0)) + (1 - alpha) * F.coalesce("v", F.lit(0.0))).alias("score"), source.alias("source"))


def normalized(scored: DataFrame, method: str, key: str = "doc_id") -> DataFrame:
    """Scores by ``minmax`` (equal scores: 1), ``zscore`` (no spread: 0.5) or ``none``."""
    if method == "none":
        return scored.select(key, "score")
    stats = F.broadcast(scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd")))
    rows = scored.select(key, "score").crossJoin(stats)
    if method == "minmax":
        value = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")))
    elif method == "zscore":
        value = F.when(F.col("sd") == 0, 0.5).otherwise(F.try_divide(F.col("score") - F.col("mu"), F.col("sd")))
    else:
        raise ValueError(f"unknown normalization {method}")
    return rows.select(key, value.alias("score"))


def recency(ts: Column, as_of: Column) -> Column:
    """exp(-0.023 * age in days), between 0 and 1; 0.5 if there is no time."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400.0
    # least and greatest pass over nulls, so a missing time is asked for first
    return F.when(ts.isNull() | as_of.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-0.023 * age))))


WEIGHTS = {"vector": 0.6, "keyword": 0.3, "recency": 0.1, "confidence": 0.0}


def weighted_fusion(
    vector: DataFrame, keyword: DataFrame, meta: DataFrame, as_of: Column, method: str = "minmax", weights: dict[str, float] = WEIGHTS, key: str = "doc_id", least_vector: float = 0.0, least_keyword: float = 0.0
) -> DataFrame:
    """Normalized signals, weighted: vector, keyword, recency, confidence; (key, parts, score).

    A vector or keyword signal below its threshold counts as 0.
    """
    v = normalized(vector, method, key).withColumnRenamed("score", "v")
    q = normalized(keyword, method, key).withColumnRenamed("score", "q")
    rows = v.join(q, key, "full").join(meta.select(key, "ts", "confidence"), key, "left")

    def signal(name: str, least: float) -> Column:
        value = F.coalesce(name, F.lit(0.0))
        return F.when(value < least, 0.0).otherwise(value) if least else value

    signals = {"vector": signal("v", least_vector), "keyword": signal("q", least_keyword), "recency": recency(F.col("ts"), as_of), "confidence": F.coalesce("confidence", F.lit(0.5))}
    parts = {n: c * weights[n] for n, c in signals.items()}
    total = parts["vector"] + parts["keyword"] + parts["recency"] + parts["confidence"]
    return rows.select(key, *(c.alias(n) for n, c in parts.items()), total.alias("score"))


def verify(results: DataFrame, chunks: DataFrame, query: Sequence[float], threshold: float = 0.6, least_refs: int = 2, verified_from: float = 0.7, key: str = "vec_id") -> DataFrame:
    """results with cross_refs, agreement, contradicted, verification, verified and flags.

    ``results`` are the few rows of a top-k, with key, topic and text.  Chunks of other topics
    that resemble the query count; they are added up once a topic, and a result gets the total
    less its own topic's.  A result that a sibling of its topic contradicts lacks 0.2.
    """
    sim = V.cosine(V.as_double("embedding"), literal_vector(query))
    near = chunks.select("topic", sim.alias("s")).where(F.col("s") > threshold).groupBy("topic").agg(F.count(F.lit(1)).alias("own_n"), F.sum("s").alias("own_s"))
    total = F.broadcast(near.agg(F.coalesce(F.sum("own_n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("own_s"), F.lit(0.0)).alias("all_s")))
    own = F.broadcast(results.select(F.col(key).alias("_key"), F.col("topic").alias("_topic"), X.contradiction_features(F.col("text")).alias("_own")))
    siblings = chunks.select(key, "topic", X.contradiction_features(F.col("text")).alias("_f")).join(own, (F.col("topic") == F.col("_topic")) & (F.col(key) != F.col("_key")))
    contradicted = siblings.where(X.contradicts(F.col("_f"), F.col("_own"))).select("_key").distinct().withColumn("contradicted", F.lit(True))
    rows = results.join(near, "topic", "left").crossJoin(total)
    rows = rows.join(contradicted, rows[key] == contradicted["_key"], "left").drop("_key").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    refs = F.col("all_n") - F.coalesce("own_n", F.lit(0))
    agreement = F.coalesce(F.try_divide(F.col("all_s") - F.coalesce("own_s", F.lit(0.0)), refs), F.lit(0.0))
    rows = rows.withColumns({"cross_refs": refs, "agreement": F.when(refs > 0, agreement).otherwise(0.0)})
    score = 0.5 * F.col("agreement") + 0.3 * F.least(F.lit(1.0), F.col("cross_refs") / least_refs) + F.when(F.col("contradicted"), 0.0).otherwise(0.2)
    flags = F.array_compact(F.array(F.when(F.col("cross_refs") == 0, "no_cross_refs"), F.when(F.col("contradicted"), "contradiction_detected"), F.when(F.col("agreement") < 0.5, "low_agreement")))
    return rows.withColumns({"verification": score, "flags": flags}).withColumn("verified", F.col("verification") >= verified_from).drop("own_n", "own_s", "all_n", "all_s")


def kmeans_lists(vectors: DataFrame, lists: int, sample: int = 4096, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """Centroids of an inverted file, fitted on a bounded sample of vectors chosen by a hash."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def _distances(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (m * m).sum(axis=1, keepdims=True) - 2 * m @ c.T + (c * c).sum(axis=1)


def with_list(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vectors with ``bucket``, the nearest centroid: every row is indexed."""
    ship_package(vectors.sparkSession)

    @F.arrow_udf("int")
    def nearest(embedding: pa.Array) -> pa.Array:
        return pa.array(_distances(_matrix(embedding, c.shape[1]), c).argmin(axis=1).astype(np.int32))

    return vectors.withColumn("bucket", nearest("embedding"))


def ivf_search(indexed: DataFrame, c: np.ndarray, query: Sequence[float], k: int, probes: int) -> DataFrame:
    """The k best of the lists nearest to the query, by exact cosine distance."""
    order = np.argsort(((c - np.asarray(query)) ** 2).sum(axis=1), kind="stable")[:probes].tolist()
    rows = indexed.where(F.col("bucket").isin([int(i) for i in order]))
    return topk(rows.withColumn("score", V.cosine_distance(V.as_double("embedding"), literal_vector(query))), k, ascending=True)


def ivf_recall(vectors: DataFrame, c: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, recall): which share of each query's exact k best lies in the lists that are probed.

    Within its lists the search is exact, so these are just what it finds.
    """
    indexed = with_list(vectors, c).select("vec_id", "bucket")

    @F.arrow_udf("array<int>")
    def first(embedding: pa.Array) -> pa.Array:
        order = np.argsort(_distances(_matrix(embedding, c.shape[1]), c), axis=1, kind="stable")[:, :probes]
        return pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))

    probed = queries.select(F.col("vec_id").alias("query_id"), first("embedding").alias("lists"))
    best = batch_topk(queries.select("vec_id", "embedding"), vectors.select("vec_id", "embedding"), k)
    rows = best.join(indexed, "vec_id").join(probed, "query_id")
    return rows.groupBy("query_id").agg(F.avg(F.array_contains("lists", F.col("bucket")).cast("double")).alias("recall"))


def index_settings(n: int, dim: int) -> dict[str, int]:
    """Lists and subquantizers by the size of the corpus."""
    lists = 256 if n < 10_000 else 1024 if n < 100_000 else 4096 if n < 1_000_000 else 8192
    return {"nlist": lists, "m": min(64, max(16, dim // 16))}


def merge_max(lists: Sequence[tuple[str, DataFrame, float]], k: int, key: str = "vec_id") -> DataFrame:
    """(key, score, via): weighted scores of several lists, the largest one of each key."""
    out: DataFrame | None = None
    for name, df, weight in lists:
        part = df.select(key, (F.col("score") * weight).alias("score"), F.lit(name).alias("via"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(key).agg(F.max(F.struct("score", "via")).alias("b")).select(key, "b.score", "b.via")
    return topk(best, k, key=key)
