"""One query for each operator of the survey, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import filters, maintain, metrics, search
from engram.session import few, scratch_folder, spread
from engram.sources import store
from engram.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Of 16 lists so many are probed, for a recall of over 0.9 on vectors that hardly cluster.
PROBES = 12

TERMS = ["the", "thing", "then", "thing", "oferer", "rent"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def as_of() -> Column:
    """The time of all reports."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; those whose rows make much work in as many tasks as there are cores."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "embeddings", "conversations", "pages") else df


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def chunk_columns(i: Column) -> dict[str, Column]:
    """Metadata derived from an id by plain arithmetic."""
    return {
        "confidence": (30 + (i * 37) % 70) / F.lit(100.0),
        "staleness": ((i * 13) % 100) / F.lit(100.0),
        "quality": ((i * 7) % 100) / F.lit(100.0),
        "verified": i % 3 == 0,
        "ts": F.timestamp_seconds(F.lit(1704067200) + i * 60),
        "ttl_ts": F.when(i % 5 == 0, F.timestamp_seconds(F.lit(1704067200) + i * 3600)),
        "ttl_seconds": F.when(i % 5 == 0, i * 3600),
    }


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "embeddings").withColumn("topic", F.concat(F.lit("t"), "label"))
    return df.withColumns(chunk_columns(F.col("vec_id"))).withColumn("seq", F.col("vec_id"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents").withColumn("topic", F.col("source")).withColumns(chunk_columns(F.col("doc_id")))
    return df.withColumns({"seq": F.col("doc_id"), "entropy": X.entropy(F.col("text"))})


def vector_of(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """One query vector, a row."""
    return list(spark.read.parquet(f"{sf}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


META = """(30+(i*37)%70)/1e2 AS confidence, ((i*13)%100)/1e2 AS staleness, ((i*7)%100)/1e2 AS quality, i%3=0 AS verified,
 TIMESTAMP '2024-01-01' + to_seconds(i*60) AS ts, CASE WHEN i%5=0 THEN TIMESTAMP '2024-01-01' + to_seconds(i*3600) END AS ttl_ts,
 CASE WHEN i%5=0 THEN i*3600 END AS ttl_seconds"""
VEC = f"v AS (SELECT vec_id, 't'||label AS topic, embedding::DOUBLE[] AS e, {META.replace('i*', 'vec_id*').replace('i%', 'vec_id%')} FROM embeddings)"
DOC = f"d AS (SELECT doc_id, text, lang, source, source AS topic, {META.replace('i*', 'doc_id*').replace('i%', 'doc_id%')} FROM documents)"
Q0 = "q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id=0)"


def cos(a: str, b: str) -> str:
    return f"list_dot_product({a},{b})/((sqrt(list_dot_product({a},{a}))+1e-9)*(sqrt(list_dot_product({b},{b}))+1e-9))"


CENT = """c AS (SELECT topic, list(x ORDER BY pos) AS c FROM (SELECT topic, pos, avg(e[pos]) AS x FROM v, range(1, 65) r(pos) GROUP BY topic, pos) GROUP BY topic)"""


# --- vectors ------------------------------------------------------------------------------


@query(f"WITH {VEC}, {Q0} SELECT vec_id, round({cos('e', 'qe')}, 6) AS score FROM v, q ORDER BY {cos('e', 'qe')} DESC, vec_id LIMIT 10")
def vec_exact_topk(spark, sf):
    return search.exact(vectors(spark, sf), vector_of(spark, sf), 10).select("vec_id", r6("score").alias("score"))


@query(f"WITH {VEC}, {Q0} SELECT vec_id, round(list_dot_product(e, qe), 6) AS score FROM v, q ORDER BY list_dot_product(e, qe) DESC, vec_id LIMIT 10")
def vec_dot_topk(spark, sf):
    return search.exact(vectors(spark, sf), vector_of(spark, sf), 10, V.dot).select("vec_id", r6("score").alias("score"))


@query(f"WITH {VEC}, {Q0} SELECT vec_id, round(list_distance(e, qe), 6) AS score FROM v, q ORDER BY list_distance(e, qe), vec_id LIMIT 10")
def vec_l2_topk(spark, sf):
    return search.exact(vectors(spark, sf), vector_of(spark, sf), 10, V.euclidean, ascending=True).select("vec_id", r6("score").alias("score"))


@query(
    f"""WITH {VEC} SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {cos("a.e", "b.e")} AS s,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round({cos("a.e", "b.e")}, 9) DESC, b.vec_id) AS rank
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5"""
)
def vec_batch_topk(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    found = search.batch_topk(v.where(F.col("vec_id") % 20 == 0), v, 5)
    return found.select("query_id", "vec_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VEC} SELECT topic, pos-1 AS pos, round(avg(e[pos]), 6) AS value FROM v, range(1, 65) r(pos) GROUP BY topic, pos")
def topic_centroids(spark, sf):
    return search.centroids(vectors(spark, sf)).select("topic", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query(f"WITH {VEC}, {Q0}, {CENT} SELECT topic, round({cos('c', 'qe')}, 6) AS score FROM c, q ORDER BY {cos('c', 'qe')} DESC, topic LIMIT 3")
def topic_prefilter(spark, sf):
    return search.prefilter(vectors(spark, sf), vector_of(spark, sf), 3).select("topic", r6("score").alias("score"))


@query(f"WITH {VEC}, {CENT} SELECT vec_id, assigned FROM (SELECT vec_id, c.topic AS assigned, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(e, c), 9) DESC, c.topic) AS r FROM v, c) WHERE r = 1")
def assign_topic(spark, sf):
    v = vectors(spark, sf)
    return search.assign_topic(v, search.centroid_vectors(v)).select("vec_id", "assigned")


SCORED = f"({cos('e', 'qe')})*(0.5+confidence)*(1-0.5*staleness)*(0.5+0.5*quality)"
TOP_TOPICS = f"t AS (SELECT topic FROM c, q ORDER BY {cos('c', 'qe')} DESC, topic LIMIT 5)"


@query(f"WITH {VEC}, {Q0}, {CENT}, {TOP_TOPICS} SELECT vec_id, topic, round({SCORED}, 6) AS score FROM v, q WHERE topic IN (FROM t) ORDER BY {SCORED} DESC, vec_id LIMIT 10")
def memory_query(spark, sf):
    return search.memory_query(vectors(spark, sf), vector_of(spark, sf), 10).select("vec_id", "topic", r6("score").alias("score"))


@query(
    f"""WITH {VEC}, {Q0}, {CENT}, {TOP_TOPICS} SELECT vec_id, topic, round({SCORED}, 6) AS score FROM v, q
    WHERE topic IN (FROM t) AND confidence >= 0.5 AND verified ORDER BY {SCORED} DESC, vec_id LIMIT 10"""
)
def memory_query_filtered(spark, sf):
    found = search.memory_query(vectors(spark, sf), vector_of(spark, sf), 10, where=(F.col("confidence") >= 0.5) & F.col("verified"))
    return found.select("vec_id", "topic", r6("score").alias("score"))


@query(f"WITH {VEC}, {Q0} SELECT vec_id, round({cos('e', 'qe')}, 6) AS score FROM v, q WHERE topic='t3' ORDER BY {cos('e', 'qe')} DESC, vec_id LIMIT 10")
def recall_topic(spark, sf):
    return search.exact(vectors(spark, sf).where(F.col("topic") == "t3"), vector_of(spark, sf), 10).select("vec_id", r6("score").alias("score"))


def memories(spark: SparkSession, sf: str, embedding: bool = True) -> DataFrame:
    """Vectors with the texts of the documents of the same numbers; on request without the vectors themselves.

    Documents far outweigh what is left of the vectors then, and are not shuffled if those are few.
    """
    v = vectors(spark, sf) if embedding else few(vectors(spark, sf).drop("embedding"))
    return v.join(read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "lang"), "vec_id")


def _verified(spark, sf, k=10):
    m, q = memories(spark, sf), vector_of(spark, sf)
    return search.verify(search.exact(m, q, k).select("vec_id", "topic", "text", "score"), m, q, 0.1)


def _neg(names: list[str]) -> str:
    return "(" + " OR ".join("contains(t, '" + w.replace("'", "''") + "')" for w in names) + ")"


#: Columns of contradiction features of a lower-cased text t, and the test of two rows a and b.
FEATURES = f"""{_neg(X.NEGATIONS)} AS neg, {_neg(X.NEGATIONS_SHORT)} AS negs, list_transform(regexp_extract_all(t, '\\b\\d+\\.?\\d*\\b'), lambda x: x::DOUBLE) AS nums,
 list_distinct(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: length(x) > 3)) AS w, list_sort(list_distinct(regexp_extract_all(t, '{X.DATE}', 1))) AS dates"""
CONTRADICTS = """(len(list_filter(a.nums, lambda x: len(list_filter(b.nums, lambda y: abs(x-y)/(greatest(x, y)+1e-9) > 0.1)) > 0)) > 0
 OR (a.neg <> b.neg AND len(list_intersect(a.w, b.w)) >= 3) OR (len(a.dates) > 0 AND len(b.dates) > 0 AND a.dates <> b.dates AND len(list_intersect(a.w, b.w)) >= 2))"""

VERIFY = f"""WITH {VEC}, {Q0}, s AS (SELECT vec_id, topic, lower(text) AS t, {cos("e", "qe")} AS s FROM v JOIN documents ON doc_id = vec_id, q), f AS (SELECT vec_id, topic, s, {FEATURES} FROM s),
 r AS (SELECT * FROM f ORDER BY s DESC, vec_id LIMIT 10),
 k AS (SELECT b.vec_id, count(a.vec_id) > 0 AS contradicted FROM r b LEFT JOIN f a ON a.topic = b.topic AND a.vec_id <> b.vec_id AND {CONTRADICTS} GROUP BY b.vec_id),
 x AS (SELECT r.vec_id, r.s AS score, contradicted, count(o.s) AS cross_refs, coalesce(avg(o.s), 0) AS agreement FROM r JOIN k USING (vec_id) LEFT JOIN s o ON o.topic <> r.topic AND o.s > 0.1 GROUP BY r.vec_id, r.s, contradicted),
 y AS (SELECT *, 0.5*agreement + 0.3*least(1.0, cross_refs/2) + CASE WHEN contradicted THEN 0 ELSE 0.2 END AS verification FROM x)"""


@query(VERIFY + """ SELECT vec_id, cross_refs, round(agreement, 6) AS agreement, round(verification, 6) AS verification, verification >= 0.7 AS verified,
 concat_ws(',', CASE WHEN cross_refs = 0 THEN 'no_cross_refs' END, CASE WHEN contradicted THEN 'contradiction_detected' END, CASE WHEN agreement < 0.5 THEN 'low_agreement' END) AS flags FROM y""")
def verify_results(spark, sf):
    return _verified(spark, sf).select("vec_id", "cross_refs", r6("agreement").alias("agreement"), r6("verification").alias("verification"), "verified", F.array_join("flags", ",").alias("flags"))


@query(VERIFY + " SELECT vec_id, round(score*(0.5+0.5*verification), 6) AS score FROM y")
def verify_and_score(spark, sf):
    return _verified(spark, sf).select("vec_id", r6(F.col("score") * (0.5 + 0.5 * F.col("verification"))).alias("score"))


# --- codecs -------------------------------------------------------------------------------


def _codec_sql(bits: int) -> str:
    q = (1 << (bits - 1)) - 1
    return f"""WITH {VEC}, s AS (SELECT vec_id, e, (list_max(list_transform(e, lambda x: abs(x)))+1e-9)/{q} AS scale FROM v),
    u AS (SELECT vec_id, e, scale, list_transform(e, lambda x: (greatest(-{q}, least({q}, round_even(x/scale, 0)))+{q})::INT) AS u FROM s)"""


def _quantize_query(bits: int) -> None:
    sql = _codec_sql(bits) + " SELECT vec_id, round(scale, 9) AS scale, array_to_string(u, ',') AS u FROM u"

    def run(spark, sf):
        q = vectors(spark, sf).select("vec_id", V.quantize(V.as_double("embedding"), bits).alias("q"))
        return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.array_join(F.col("q.values").cast("array<string>"), ",").alias("u"))

    run.__name__ = f"quantize_q{bits}"
    query(sql)(run)


for _bits in V.BITS:
    _quantize_query(_bits)


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_codec_sql(b)}, d AS (SELECT e, list_transform(u, lambda x: (x-{(1 << (b - 1)) - 1})*scale) AS d FROM u) SELECT {b} AS bits, round(avg({cos('e', 'd')}), 6) AS mean, round(min({cos('e', 'd')}), 6) AS least, round(32.0/{b}, 6)::DOUBLE AS ratio FROM d)"
        for b in V.BITS
    )
)
def codec_fidelity(spark, sf):
    v = vectors(spark, sf).select(V.as_double("embedding").alias("e"))
    parts = []
    for b in V.BITS:
        c = v.select(V.cosine(F.col("e"), V.dequantize(V.quantize(F.col("e"), b))).alias("c"))
        parts.append(c.agg(F.lit(b).alias("bits"), r6(F.avg("c")).alias("mean"), r6(F.min("c")).alias("least"), r6(V.compression_ratio(F.lit(b))).alias("ratio")))
    return store.union_all(parts)


@query(
    f"""WITH {VEC}, u AS (SELECT vec_id, e, list_transform(e, lambda x: round_even((greatest(-1.0, least(1.0, x))+1)/2*15, 0)::INT) AS u FROM v)
    SELECT vec_id, list_sum(u)::BIGINT AS total, round({cos("e", "list_transform(u, lambda x: x/15.0::DOUBLE*2-1)")}, 6) AS fidelity FROM u"""
)
def fixed_q4(spark, sf):
    e = V.as_double("embedding")
    u = vectors(spark, sf).select("vec_id", e.alias("e"), V.quantize_fixed(e, 4).alias("u"))
    return u.select("vec_id", F.aggregate("u", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), r6(V.cosine(F.col("e"), V.dequantize_fixed(F.col("u"), 4))).alias("fidelity"))


@query(
    f"""WITH {VEC}, s AS (SELECT vec_id, e, list_min(e) AS z, CASE WHEN list_max(e)=list_min(e) THEN 1.0 ELSE (list_max(e)-list_min(e))/15 END AS s FROM v),
    u AS (SELECT *, list_transform(e, lambda x: greatest(0, least(15, round_even((x-z)/s, 0)))::INT) AS u FROM s)
    SELECT vec_id, round(s, 9) AS scale, round(z, 9) AS zero, list_sum(u)::BIGINT AS total, round({cos("e", "list_transform(u, lambda x: x*s+z)")}, 6) AS fidelity FROM u"""
)
def affine4(spark, sf):
    e = V.as_double("embedding")
    q = vectors(spark, sf).select("vec_id", e.alias("e"), V.quantize_affine4(e).alias("q"))
    return q.select(
        "vec_id", F.round("q.scale", 9).alias("scale"), F.round("q.zero", 9).alias("zero"), F.aggregate("q.values", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), r6(V.cosine(F.col("e"), V.dequantize_affine4(F.col("q")))).alias("fidelity")
    )


@query("SELECT vec_id, 48::BIGINT AS n_bytes, true AS same FROM embeddings")
def codec_roundtrip(spark, sf):
    q = vectors(spark, sf).select("vec_id", V.quantize(V.as_double("embedding"), 6)["values"].alias("u")).withColumn("packed", V.pack(6)("u"))
    q = q.withColumn("back", V.unpack(6)("packed", F.size("u")))
    return q.select("vec_id", F.octet_length("packed").cast("long").alias("n_bytes"), (F.col("back") == F.col("u")).alias("same"))


# --- filters ------------------------------------------------------------------------------


@query(
    """SELECT count(*) FILTER (WHERE quality IS NOT DISTINCT FROM 1) AS eq, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS ne, count(*) FILTER (WHERE coalesce(quality >= 1, false)) AS ge,
    count(*) FILTER (WHERE coalesce(quality IN (0, 1) AND quality <> 0, false)) AS in_, count(*) FILTER (WHERE NOT coalesce(quality IN (0, 1) AND quality <> 0, false)) AS not_in,
    count(*) FILTER (WHERE coalesce(contains(text, 'the'), false)) AS has, count(*) FILTER (WHERE coalesce(n_chars BETWEEN 100 AND 1000, false)) AS between_ FROM documents LEFT JOIN labels USING (doc_id)"""
)
def filter_ops(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    tests = {"eq": ("quality", "eq", 1), "ne": ("quality", "ne", 1), "ge": ("quality", "ge", 1), "in_": ("quality", "in", [0, 1]), "not_in": ("quality", "not_in", [0, 1]), "has": ("text", "contains", "the"), "between_": ("n_chars", "between", [100, 1000])}
    return rows.agg(*(F.count_if(filters.condition(*t)).alias(n) for n, t in tests.items()))


@query(f"WITH {DOC} SELECT doc_id, confidence FROM d WHERE source IS NOT DISTINCT FROM 'src3' AND confidence > 0.5 AND lang IN ('en', 'fr') AND lang <> ''")
def filter_string(spark, sf):
    return filters.parse("topic=src3, confidence>0.5, lang in (en;fr)").apply(texts(spark, sf)).select("doc_id", "confidence")


@query(f"WITH {DOC} SELECT doc_id, ttl_ts FROM d WHERE ttl_ts < TIMESTAMP '2024-02-01'")
def filter_expired(spark, sf):
    return filters.Filters().expired(as_of()).apply(texts(spark, sf)).select("doc_id", F.col("ttl_ts").cast("timestamp_ntz").alias("ttl_ts"))


# --- keyword search and fusion ------------------------------------------------------------

ANALYZED = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'),
 lambda x: regexp_full_match(x, '[a-z0-9]+') AND length(x) > 1 AND x NOT IN (""" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + ")) AS tokens FROM documents)"
SPACED = "t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS tokens FROM documents)"


def _bm25_sql(tokens: str, terms: list[str]) -> str:
    listed = ",".join(f"('{t}',{terms.count(t)})" for t in dict.fromkeys(terms))
    return f"""{tokens}, qt(term, times) AS (VALUES {listed}), st AS (SELECT count(*) AS n, greatest(1.0, avg(len(tokens))) AS avgdl FROM t),
    tf AS (SELECT doc_id, term, times, len(list_filter(tokens, lambda x: x = term)) AS tf, len(tokens) AS dl FROM t, qt),
    df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
    bm AS (SELECT doc_id, sum(times*ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id)"""


@query(f"WITH {_bm25_sql(SPACED, TERMS)} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_ws(spark, sf):
    return search.bm25(read(spark, sf, "documents"), TERMS, search.SPACED, keep_zero=True).select("doc_id", r6("score").alias("score"))


@query(f"WITH {_bm25_sql(ANALYZED, TERMS)} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0")
def bm25_analyzed(spark, sf):
    return search.bm25(read(spark, sf, "documents"), TERMS).select("doc_id", r6("score").alias("score"))


@query(
    f"""WITH {ANALYZED}, x AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM t) GROUP BY term)
    SELECT term, df, round(ln(((SELECT count(*) FROM documents)-df+0.5)/(df+0.5)+1), 6) AS idf FROM x"""
)
def bm25_terms(spark, sf):
    return search.term_statistics(read(spark, sf, "documents")).select("term", "df", r6("idf").alias("idf"))


@query(f"WITH {ANALYZED} SELECT count(*) AS doc_count, round(avg(len(tokens)), 6) AS avg_doc_len, (SELECT count(DISTINCT x) FROM (SELECT unnest(tokens) AS x FROM t)) AS unique_terms FROM t")
def bm25_stats(spark, sf):
    return search.index_statistics(read(spark, sf, "documents")).select("doc_count", r6("avg_doc_len").alias("avg_doc_len"), "unique_terms")


FUSE = f"""WITH {_bm25_sql(ANALYZED, TERMS)}, {VEC}, {Q0}, kw AS (SELECT doc_id, score FROM bm WHERE score > 0),
 vs AS (SELECT vec_id AS doc_id, {cos("e", "qe")} AS score FROM v, q)"""


def _lists(spark, sf):
    kw = search.bm25(read(spark, sf, "documents"), TERMS)
    vs = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), V.cosine(V.as_double("embedding"), search.literal_vector(vector_of(spark, sf))).alias("score"))
    return kw, vs


@query(
    FUSE
    + """, a AS (SELECT doc_id, 1.0/(60+row_number() OVER (ORDER BY score DESC, doc_id)-1) AS p FROM (SELECT * FROM kw ORDER BY score DESC, doc_id LIMIT 20)),
    b AS (SELECT doc_id, 1.0/(60+row_number() OVER (ORDER BY score DESC, doc_id)-1) AS p FROM (SELECT * FROM vs ORDER BY score DESC, doc_id LIMIT 20))
    SELECT doc_id, round(sum(p), 6) AS score FROM (FROM a UNION ALL FROM b) GROUP BY doc_id"""
)
def rrf_fusion(spark, sf):
    return search.rrf(_lists(spark, sf), 20).select("doc_id", r6("score").alias("score"))


@query(
    FUSE
    + """ SELECT doc_id, round(0.5*coalesce(kw.score, 0)+0.5*coalesce(vs.score, 0), 6) AS score,
    CASE WHEN vs.score IS NULL THEN 'bm25' WHEN kw.score IS NULL THEN 'vector' ELSE 'hybrid' END AS source FROM kw FULL JOIN vs USING (doc_id)"""
)
def linear_fusion(spark, sf):
    kw, vs = _lists(spark, sf)
    return search.linear_fusion(kw, vs).select("doc_id", r6("score").alias("score"), "source")


def _weighted_sql(method: str) -> str:
    n = {"minmax": "CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score-min(score) OVER ())/(max(score) OVER ()-min(score) OVER ()) END", "zscore": "CASE WHEN stddev_pop(score) OVER () = 0 THEN 0.5 ELSE (score-avg(score) OVER ())/stddev_pop(score) OVER () END"}[method]
    return (
        FUSE
        + f""", {DOC}, a AS (SELECT doc_id, {n} AS s FROM vs), b AS (SELECT doc_id, {n} AS s FROM kw),
    j AS (SELECT doc_id, coalesce(a.s, 0) AS v, coalesce(b.s, 0) AS k FROM a FULL JOIN b USING (doc_id))
    SELECT doc_id, round(0.6*v, 6) AS vector, round(0.3*k, 6) AS keyword,
    round(0.6*v+0.3*k+0.1*CASE WHEN ts IS NULL THEN 0.5 ELSE greatest(0, least(1, exp(-0.023*(epoch(TIMESTAMP '2024-02-01')-epoch(ts))/86400))) END, 6) AS score FROM j LEFT JOIN d USING (doc_id)"""
    )


def _weighted(spark, sf, method):
    kw, vs = _lists(spark, sf)
    return search.weighted_fusion(vs, kw, texts(spark, sf), as_of(), method)


@query(_weighted_sql("minmax"))
def weighted_fusion_minmax(spark, sf):
    return _weighted(spark, sf, "minmax").select("doc_id", r6("vector").alias("vector"), r6("keyword").alias("keyword"), r6("score").alias("score"))


@query(_weighted_sql("zscore"))
def weighted_fusion_zscore(spark, sf):
    return _weighted(spark, sf, "zscore").select("doc_id", r6("vector").alias("vector"), r6("keyword").alias("keyword"), r6("score").alias("score"))


@query(f"WITH {DOC} SELECT doc_id, round(greatest(0, least(1, exp(-0.023*(epoch(TIMESTAMP '2024-02-01')-epoch(ts))/86400))), 6) AS recency FROM d")
def recency(spark, sf):
    return texts(spark, sf).select("doc_id", r6(search.recency(F.col("ts"), as_of())).alias("recency"))


@query(f"WITH {VEC}, {Q0}, m AS (SELECT vec_id, max(s) AS score, arg_max(via, s) AS via FROM (SELECT vec_id, 0.6*{cos('e', 'qe')} AS s, 'text' AS via FROM v, q UNION ALL SELECT vec_id, 0.4*list_dot_product(e, qe), 'clip' FROM v, q) GROUP BY vec_id) SELECT vec_id, round(score, 6) AS score, via FROM m ORDER BY m.score DESC, vec_id LIMIT 10")
def merge_max(spark, sf):
    v, q = vectors(spark, sf), search.literal_vector(vector_of(spark, sf))
    e = V.as_double("embedding")
    return search.merge_max([("text", v.withColumn("score", V.cosine(e, q)), 0.6), ("clip", v.withColumn("score", V.dot(e, q)), 0.4)], 10).select("vec_id", r6("score").alias("score"), "via")


@query(f"WITH {VEC}, {Q0} SELECT vec_id, round(1-list_dot_product(e, qe)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(qe, qe))+1e-8), 6) AS score FROM v, q ORDER BY round(1-list_dot_product(e, qe)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(qe, qe))+1e-8), 12), vec_id LIMIT 10")
def ivf_all_probes(spark, sf):
    v = read(spark, sf, "embeddings")
    c = search.kmeans_lists(v, 8)
    return search.ivf_search(search.with_list(v, c), c, vector_of(spark, sf), 10, 8).select("vec_id", r6("score").alias("score"))


@query()
def ivf_search(spark, sf):
    v = read(spark, sf, "embeddings")
    c = search.kmeans_lists(v, 16)
    return search.ivf_search(search.with_list(v, c), c, vector_of(spark, sf), 10, PROBES).select("vec_id", r6("score").alias("score"))


# --- texts --------------------------------------------------------------------------------


def _reason_sql() -> str:
    esc = lambda p: p.replace("'", "''")
    any_ = lambda ps: " OR ".join(f"regexp_matches(t, '{esc(p)}')" for p in ps)
    code = "+".join(f"regexp_matches(t, '{esc(p)}')::INT" for p in X.CODE)
    return f"""r AS (SELECT doc_id, CASE WHEN length(t) < 10 THEN 'too_short' WHEN length(t) > 5000 THEN 'too_long' WHEN lower(source) IN ({",".join(f"'{x}'" for x in X.BLOCKED_TOPICS)}) THEN 'blocked_topic'
    WHEN {any_(X.SECRETS)} THEN 'secret' WHEN {any_(X.DEBUG)} THEN 'debug' WHEN {code} >= 2 THEN 'code' WHEN {any_(X.BLOCKED)} THEN 'blocked_pattern' END AS reason
    FROM (SELECT doc_id, source, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents))"""


@query(f"WITH {_reason_sql()} SELECT doc_id, reason FROM r WHERE reason IS NOT NULL")
def exclusion_rules(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", X.exclusion_reason(F.col("text"), F.col("source")).alias("reason"))
    return rows.where(F.col("reason").isNotNull())


@query(f"WITH {_reason_sql()} SELECT CASE WHEN reason IS NULL THEN 'imported' ELSE 'excluded' END AS status, count(*) AS n FROM r GROUP BY 1")
def bulk_import_counts(spark, sf):
    return store.ingest_status(read(spark, sf, "documents"), X.exclusion_reason(F.col("text"), F.col("source"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


WORDS = f"{DOC}, w AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM d), x AS (SELECT *, len(w) AS n, len(list_distinct(list_transform(w, lambda y: lower(y))))/greatest(len(w), 1) AS dv FROM w)"


@query(
    f"""WITH {WORDS}, y AS (SELECT *, n >= 5 AND dv > 0.5 AS sp, regexp_matches(text, '\\d+\\.?\\d*') AS nu, regexp_matches(text, '\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}') AS da FROM x)
    SELECT doc_id, round(greatest(0, least(1, confidence))*0.3+greatest(0, 1-staleness)*0.25+least(1.0, (CASE WHEN sp THEN 0.4 ELSE 0 END)+(CASE WHEN nu THEN 0.3 ELSE 0 END)+(CASE WHEN da THEN 0.3 ELSE 0 END))*0.25+(CASE WHEN verified THEN quality ELSE 0 END)*0.2, 6)::DOUBLE AS overall,
    concat_ws(',', CASE WHEN n < 5 THEN 'too_short' END, CASE WHEN dv < 0.3 THEN 'low_diversity' END, CASE WHEN NOT sp AND NOT nu THEN 'vague' END) AS flags FROM y"""
)
def quality_score(spark, sf):
    q = X.quality(F.col("text"), F.col("confidence"), F.col("staleness"), F.col("verified"), F.col("quality"))
    return texts(spark, sf).select("doc_id", q.alias("q")).select("doc_id", r6("q.overall").alias("overall"), F.array_join("q.flags", ",").alias("flags"))


@query(
    f"""WITH {WORDS} SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(least(1, greatest(0, confidence*0.3+(1-staleness)*0.3+((CASE WHEN dv > 0.5 THEN 0.3 ELSE 0 END)+(CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 0.2 ELSE 0 END)
    +(CASE WHEN len(list_filter(w, lambda z: length(z) = 10 AND contains(z, '-'))) > 0 THEN 0.2 ELSE 0 END)+(CASE WHEN n >= 10 THEN 0.3 ELSE 0 END))*0.4)), 6)::DOUBLE END AS score FROM x"""
)
def keyword_density(spark, sf):
    return texts(spark, sf).select("doc_id", r6(X.keyword_density(F.col("text"), F.col("confidence"), F.col("staleness"))).alias("score"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'paid') AND contains(lower(text), 'unpaid') THEN 0.9::DOUBLE WHEN contains(lower(text), 'approved') AND contains(lower(text), 'rejected') THEN 0.9 WHEN contains(lower(text), 'yes') AND contains(lower(text), 'no') THEN 0.5 ELSE 0 END AS score FROM documents")
def text_contradiction(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.text_contradiction(F.col("text"), batch=True).alias("score"))


def _turns(spark, sf):
    """Conversations as topics: their turns are few, so pairs within a topic are few."""
    rows = read(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("topic"), F.col("turn").alias("seq"), "text")
    return rows.withColumns({"confidence": F.lit(0.9), "staleness": F.lit(0.1)})


PAIRS = f"""f AS (SELECT 'c'||conv_id AS topic, turn AS seq, {FEATURES} FROM (SELECT *, lower(text) AS t FROM conversations)),
 p AS (SELECT a.topic, a.seq AS older, b.seq AS newer FROM f a JOIN f b ON a.topic = b.topic AND a.seq < b.seq WHERE {CONTRADICTS})"""


@query(f"WITH {PAIRS} SELECT * FROM p")
def contradiction_pairs(spark, sf):
    return maintain.contradiction_pairs(_turns(spark, sf))


@query(f"WITH {PAIRS}, n AS (SELECT topic, older AS seq, count(*) AS n FROM p GROUP BY ALL) SELECT f.topic, f.seq, round(0.9*pow(0.6, coalesce(n, 0)), 6) AS confidence, round(least(1.0, 0.1+0.25*coalesce(n, 0)), 6)::DOUBLE AS staleness FROM f LEFT JOIN n USING (topic, seq)")
def contradiction_decay(spark, sf):
    return maintain.contradiction_decay(_turns(spark, sf)).select("topic", "seq", r6("confidence").alias("confidence"), r6("staleness").alias("staleness"))


def _absolute_sql() -> str:
    t = "text"
    for p in X.VAGUE:
        t = f"regexp_replace({t}, '{p}', '', 'gi')"
    for w in X.VAGUE_LITERALS:
        t = f"replace({t}, '{w}', '')"
    return f"trim(regexp_replace({t}, '\\n+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT doc_id, md5(upper(t[1]) || t[2:]) AS digest FROM (SELECT doc_id, {_absolute_sql()} AS t FROM documents)")
def make_absolute(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(X.make_absolute(F.col("text"))).alias("digest"))


@query(
    """WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t)-1200)/1000))::BIGINT + 1)) AS pos FROM t WHERE t <> '')
    SELECT doc_id, pos, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, pos, trim(substr(t, pos*1000+1, 1200), ' ' || chr(9) || chr(10) || chr(13)) AS c FROM p) WHERE c <> ''"""
)
def chunk_text(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.explode(X.chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.pos").cast("long").alias("pos"), F.length("c.chunk").cast("long").alias("n"), F.md5("c.chunk").alias("digest"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'))), '|') AS emails,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'https?://[^\\s]+'))), '|') AS urls, len(regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s?(usd|eur|czk|gbp|\\$|€|kč)'))::BIGINT AS n_money FROM documents"""
)
def entities(spark, sf):
    e = read(spark, sf, "documents").select("doc_id", X.entities(F.col("text")).alias("e"))
    return e.select("doc_id", F.array_join("e.emails", "|").alias("emails"), F.array_join("e.urls", "|").alias("urls"), F.size("e.money").cast("long").alias("n_money"))


@query(
    """SELECT doc_id, CASE WHEN contains(t, 'invoice') OR contains(t, 'amount due') OR contains(t, 'iban') THEN 'invoice' WHEN contains(t, 'contract') OR contains(t, 'agreement') THEN 'contract'
    WHEN contains(t, 'meeting') OR contains(t, 'agenda') THEN 'meeting_notes' WHEN contains(t, 'error') OR contains(t, 'exception') THEN 'log' ELSE 'generic_text' END AS kind FROM (SELECT doc_id, lower(text) AS t FROM documents)"""
)
def schema_detect(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.schema_of(F.col("text")).alias("kind"))


@query("SELECT doc_id, sha1(text) AS text_hash, substr(sha1(text), 1, 16) AS short_id, round(least(1.0, length(text)/500), 6)::DOUBLE AS entropy, length(text[:200]) AS preview, CASE WHEN length(text) > 30 THEN 0.85::DOUBLE ELSE 0.55 END AS etl_confidence FROM documents")
def derived_columns(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id", F.sha1(t).alias("text_hash"), F.substring(F.sha1(t), 1, 16).alias("short_id"), r6(X.entropy(t)).alias("entropy"), F.length(F.substring(t, 1, 200)).cast("long").alias("preview"), F.when(F.length(t) > 30, 0.85).otherwise(0.55).alias("etl_confidence")
    )


@query("SELECT source AS topic, doc_id, printf('c%04d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS chunk_id FROM documents")
def chunk_ids(spark, sf):
    n = F.row_number().over(Window.partitionBy("topic").orderBy("seq"))
    return texts(spark, sf).select("topic", "doc_id", F.format_string("c%04d", n).alias("chunk_id"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role IN ('user', 'assistant', 'system')")
def session_messages(spark, sf):
    return store.messages(read(spark, sf, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


# --- maintenance --------------------------------------------------------------------------


@query(f"WITH {VEC} SELECT vec_id, round(confidence*pow(0.5, (epoch(TIMESTAMP '2024-02-01')-epoch(ts))/(30*86400.0)), 6) AS confidence FROM v")
def decay_halflife(spark, sf):
    age = F.unix_timestamp(as_of()) - F.unix_timestamp("ts")
    return vectors(spark, sf).select("vec_id", r6(maintain.half_life(F.col("confidence"), age, 30.0)).alias("confidence"))


@query(
    f"""WITH {VEC}, a AS (SELECT *, epoch(TIMESTAMP '2024-02-01')-epoch(ts) AS age FROM v), b AS (SELECT *, confidence*pow(0.5, age/(30*86400.0)) AS nc FROM a)
    SELECT vec_id, round(CASE WHEN confidence <= 0.01 THEN confidence WHEN coalesce(ttl_seconds > 0 AND age >= ttl_seconds, false) THEN 0 WHEN abs(confidence-nc) > 0.01 THEN nc ELSE confidence END, 6) AS confidence FROM b"""
)
def decay_tick(spark, sf):
    return maintain.decay_tick(vectors(spark, sf), as_of()).select("vec_id", r6("confidence").alias("confidence"))


@query(f"WITH {VEC} SELECT vec_id, round(greatest(0, quality-0.01), 6) AS quality, round(CASE WHEN greatest(0, quality-0.01) <> quality THEN least(1, staleness+0.005) ELSE staleness END, 6) AS staleness FROM v")
def quality_decay(spark, sf):
    return maintain.quality_decay(vectors(spark, sf)).select("vec_id", r6("quality").alias("quality"), r6("staleness").alias("staleness"))


@query(f"WITH {VEC} SELECT topic, count(*) AS n FROM v WHERE ttl_ts IS NULL OR ttl_ts >= TIMESTAMP '2024-01-10' GROUP BY topic")
def ttl_expire(spark, sf):
    return maintain.expire_ttl(vectors(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VEC} SELECT vec_id, round(greatest(0, least(1, greatest(0, least(1, confidence+0.4))-0.7)), 6)::DOUBLE AS confidence FROM v")
def feedback(spark, sf):
    v = vectors(spark, sf)
    deltas = v.select("vec_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(0.4).alias("delta")), F.struct(F.lit(2).alias("seq"), F.lit(-0.7).alias("delta")))).alias("f")).select("vec_id", "f.*")
    return maintain.apply_feedback(v, deltas).select("vec_id", r6("confidence").alias("confidence"))


@query(
    f"""WITH {DOC}, p AS (SELECT * FROM d WHERE least(1.0, length(text)/500) >= 0.10 AND staleness <= 0.90), u AS (SELECT *, row_number() OVER (PARTITION BY topic, sha1(text) ORDER BY doc_id) AS r FROM p),
    c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, doc_id) AS k FROM u WHERE r = 1) SELECT doc_id, topic FROM c WHERE k <= 20"""
)
def consolidate_prune_dedup_cap(spark, sf):
    return maintain.cap(maintain.dedup(maintain.prune(texts(spark, sf))), 20).select("doc_id", "topic")


@query()
def leader_merge(spark, sf):
    return maintain.leader_merge(vectors(spark, sf).select("topic", "vec_id", "embedding"))


@query()
def consolidate_topics(spark, sf):
    m = memories(spark, sf).withColumn("source_refs", F.array("source"))
    done = maintain.merged(m, maintain.leader_merge(m.select("topic", "vec_id", "embedding")))
    return done.select("topic", "leader", F.col("vec_id").alias("survivor"), r6("confidence").alias("confidence"), F.array_join("source_refs", ",").alias("sources"), "members")


@query(
    f"""WITH {DOC}, n AS (SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM d WHERE topic='src1' AND sha1(text) NOT IN (SELECT sha1(text) FROM d WHERE topic='src2'))
    SELECT topic, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT topic, text FROM d UNION ALL SELECT 'src2', text FROM n WHERE r = 1) GROUP BY topic"""
)
def merge_topics(spark, sf):
    return maintain.merge_topics(texts(spark, sf), "src1", "src2").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"))


@query("SELECT CASE WHEN source='src1' AND doc_id%2=0 THEN 'src1.even' ELSE source END AS topic, count(*) AS n FROM documents GROUP BY 1")
def split_topic(spark, sf):
    return maintain.split_topic(texts(spark, sf), "src1", F.col("doc_id") % 2 == 0, "src1.even").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VEC} SELECT vec_id, round(CASE WHEN vec_id%4=0 THEN 1.0 ELSE confidence END, 6)::DOUBLE AS confidence FROM v")
def upsert_latest(spark, sf):
    base = vectors(spark, sf).select("topic", "vec_id", "confidence", "ts")
    changes = base.where(F.col("vec_id") % 4 == 0).withColumns({"confidence": F.lit(1.0), "ts": F.col("ts") + F.expr("interval 1 hour")})
    return maintain.upsert(base, changes, ["topic", "vec_id"], "ts").select("vec_id", r6("confidence").alias("confidence"))


@query(f"WITH {VEC} SELECT vec_id, CASE WHEN vec_id%3=1 THEN 'remote' ELSE 'local' END AS won FROM v")
def conflict_latest(spark, sf):
    base = vectors(spark, sf).select("vec_id", "ts")
    remote = base.withColumns({"ts": F.when(F.col("vec_id") % 3 == 1, F.col("ts") + F.expr("interval 1 minute")).otherwise(F.col("ts")), "won": F.lit("remote")})
    return maintain.resolve_conflicts(base.withColumn("won", F.lit("local")), remote, "vec_id", "ts").select("vec_id", "won")


# --- reports ------------------------------------------------------------------------------


@query(
    f"""WITH {VEC} SELECT count(*) AS total_chunks, count(DISTINCT topic) AS total_topics, round(avg(confidence), 6) AS avg_confidence, round(avg(staleness), 6) AS avg_staleness, round(avg(quality), 6) AS avg_quality,
    count(*) FILTER (WHERE coalesce(ttl_ts < TIMESTAMP '2024-02-01', false)) AS expired, count(*) FILTER (WHERE staleness > 0.5) AS contradicted, count(*) FILTER (WHERE verified) AS verified FROM v"""
)
def store_metrics(spark, sf):
    m = metrics.store_metrics(vectors(spark, sf), as_of())
    return m.select(*(r6(c).alias(c) if c.startswith("avg") else F.col(c) for c in m.columns))


@query(f"WITH {VEC} SELECT topic, count(*) AS chunks, round(0.4*avg(confidence)+0.3*(1-avg(staleness))+0.3*avg(quality), 6) AS health FROM v GROUP BY topic")
def topic_health(spark, sf):
    return metrics.topic_health(vectors(spark, sf)).select("topic", "chunks", r6("health").alias("health"))


@query(f"WITH {VEC} SELECT topic, count(*) AS chunks, round(avg(confidence), 6) AS avg_confidence FROM v GROUP BY ROLLUP (topic)")
def topic_stats(spark, sf):
    return metrics.topic_stats(vectors(spark, sf)).select("topic", "chunks", r6("avg_confidence").alias("avg_confidence"))


@query(f"WITH {VEC}, x AS (SELECT topic, count(*) AS chunks, count(*) FILTER (WHERE staleness > 0.7) AS stale FROM v GROUP BY topic) SELECT topic, chunks, stale, round(1-stale/chunks, 6) AS retention, CASE WHEN 1-stale/chunks > 0.8 THEN 'high' WHEN 1-stale/chunks < 0.5 THEN 'low' ELSE 'medium' END AS level FROM x")
def retention(spark, sf):
    return metrics.retention(vectors(spark, sf)).select("topic", "chunks", "stale", r6("retention").alias("retention"), "level")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def value_percentiles(spark, sf):
    return metrics.percentiles(E.read_events(spark, f"{sf}/events.parquet"), "value", "event_type").select("event_type", *(r6(p).alias(p) for p in ("p50", "p95", "p99")))


@query("WITH b AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY (30+(doc_id*37)%70) DESC, doc_id) AS r FROM documents) SELECT source AS topic, '- ' || source || ': ' || substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 100) AS line FROM b WHERE r = 1 ORDER BY 1 LIMIT 30")
def memory_index(spark, sf):
    return store.memory_index(texts(spark, sf))


# --- events -------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def events_by_type(spark, sf):
    return E.read_events(spark, f"{sf}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def events_since(spark, sf):
    return E.since(E.read_events(spark, f"{sf}/events.parquet"), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_id >= 100 AND event_id < 500")
def events_range(spark, sf):
    return E.id_range(E.read_events(spark, f"{sf}/events.parquet"), 100, 500).select("event_id", "event_type")


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type, value FROM l WHERE r = 1 AND event_type <> 'view'")
def event_state_fold(spark, sf):
    return E.fold(E.read_events(spark, f"{sf}/events.parquet"), "user_id", "view")


@query("SELECT user_id, count(*) AS hits FROM events GROUP BY user_id ORDER BY hits DESC, user_id LIMIT 10")
def hot_topics(spark, sf):
    return metrics.hot(E.read_events(spark, f"{sf}/events.parquet"), "user_id", 10)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def replicate_idempotent(spark, sf):
    e = E.read_events(spark, f"{sf}/events.parquet").withColumn("origin", F.lit("a"))
    local, remote = e.where(F.col("event_id") % 3 != 0), e.where(F.col("event_id") % 3 != 1)
    once = E.replicate(local, remote)
    return E.replicate(once, remote).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


WINDOWS = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _windows_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(WINDOWS)
def event_windows(spark, sf):
    return _windows_out(E.windows(E.read_events(spark, f"{sf}/events.parquet")))


@query(WINDOWS)
def stream_windows(spark, sf):
    folder = scratch_folder(spark, "stream")
    return _windows_out(E.run_to_table(E.windows(E.stream_events(spark, sf)), f"{folder}/out", f"{folder}/checkpoint", "complete"))


@query("SELECT event_id, event_type FROM events WHERE event_id >= 1000")
def stream_replay(spark, sf):
    folder = scratch_folder(spark, "stream")
    return E.run_to_table(E.truncate(E.stream_events(spark, sf), 1000).select("event_id", "event_type"), f"{folder}/out", f"{folder}/checkpoint")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf):
    folder = scratch_folder(spark, "stream")
    return E.run_to_table(E.stream_events(spark, sf).select("user_id").dropDuplicates(["user_id"]), f"{folder}/out", f"{folder}/checkpoint")


@query("SELECT 't'||label AS topic, vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def parquet_roundtrip(spark, sf):
    folder = scratch_folder(spark, "export")
    store.export(vectors(spark, sf).select("topic", "vec_id", "embedding"), folder)
    total = F.aggregate(V.as_double("embedding"), F.lit(0.0), lambda s, x: s + x)
    return store.import_parquet(spark, folder).select("topic", "vec_id", r6(total).alias("total"))


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice*(1-l_discount)), 2) AS sum_disc_price, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def relational_summary(spark, sf):
    rows = read(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count(F.lit(1)).alias("count_order"))
