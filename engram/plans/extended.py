"""More queries of the survey: packed vectors, whole maintenance, staged retrieval, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import filters, ingest, maintain, metrics, pipeline, search
from engram.plans.catalogue import (
    ANALYZED,
    CENT,
    CONTRADICTS,
    DOC,
    FEATURES,
    FUSE,
    PROBES,
    Q0,
    SQL,
    TERMS,
    VEC,
    _absolute_sql,
    _bm25_sql,
    _codec_sql,
    _lists,
    _reason_sql,
    as_of,
    cos,
    memories,
    query,
    r6,
    read,
    texts,
    vector_of,
    vectors,
)
from engram.session import scratch_folder
from engram.sources import logs, store
from engram.streaming import events as E
from engram.streaming import stateful as S

NOW = "TIMESTAMP '2024-02-01'"
MEM = f"m AS (SELECT v.*, text, source, lang FROM v JOIN documents ON doc_id = vec_id)"


def events(spark, sf):
    return E.read_events(spark, f"{sf}/events.parquet")


# --- vectors and codecs -------------------------------------------------------------------


@query(f"WITH {VEC}, {Q0} SELECT vec_id, round(list_dot_product(e, qe)/(sqrt(list_dot_product(e, e))*sqrt(list_dot_product(qe, qe))), 6) AS score, round(list_transform(e, lambda x: x/(sqrt(list_dot_product(e, e))+1e-9))[1], 6) AS first FROM v, q")
def cosine_plain(spark, sf):
    q, e = search.literal_vector(vector_of(spark, sf)), V.as_double("embedding")
    return vectors(spark, sf).select("vec_id", r6(V.cosine_plain(e, q)).alias("score"), r6(F.get(V.l2_normalize(e), 0)).alias("first"))


def _bytes_sql(bits: int, values: str = "u") -> str:
    """Hex of a little-endian bit stream of a list of values, by plain arithmetic on eight values at a time."""
    n = 64 * bits // 8
    bit = f"(({values}[(k // {bits})::INT + 1] >> (k % {bits})::INT) & 1)"
    return f"array_to_string(list_transform(range(0, {n}), lambda b: printf('%02X', list_sum(list_transform(range(0, 8), lambda j: ((({values}[((b*8+j) // {bits})::INT + 1]) >> ((b*8+j) % {bits})::INT) & 1) << j::INT))::INT)), '')"


def _packed(bits: int) -> None:
    sql = _codec_sql(bits) + f" SELECT vec_id, {_bytes_sql(bits)} AS data, round(scale, 9) AS scale FROM u"

    def run(spark, sf):
        q = vectors(spark, sf).select("vec_id", V.quantize(V.as_double("embedding"), bits).alias("q"))
        return q.select("vec_id", F.hex(V.pack(bits)("q.values")).alias("data"), F.round("q.scale", 9).alias("scale"))

    run.__name__ = f"packed_q{bits}"
    query(sql)(run)


for _bits in V.BITS:
    _packed(_bits)


@query(_codec_sql(6).replace("WITH ", f"WITH {Q0}, ") + f", d AS (SELECT vec_id, list_transform(u, lambda x: (x-31)*scale) AS d FROM u) SELECT vec_id, round(list_dot_product(d, qe), 6) AS dot, round({cos('d', 'qe')}, 6) AS cosine FROM d, q")
def packed_similarity(spark, sf):
    q = search.literal_vector(vector_of(spark, sf))
    rows = vectors(spark, sf).select("vec_id", V.quantize(V.as_double("embedding"), 6).alias("q"))
    rows = rows.select("vec_id", V.pack(6)("q.values").alias("data"), "q.scale", "q.dim")
    return rows.select("vec_id", r6(V.dot_packed(q, F.col("data"), F.col("scale"), F.col("dim"))).alias("dot"), r6(V.cosine_packed(q, F.col("data"), F.col("scale"), F.col("dim"))).alias("cosine"))


@query(
    f"""WITH {VEC}, u AS (SELECT vec_id, e, list_transform(e, lambda x: round_even((greatest(-1.0, least(1.0, x))+1)/2*255, 0)::INT) AS u FROM v)
    SELECT vec_id, list_sum(u)::BIGINT AS total, round(list_max(list_transform(list_zip(e, u), lambda z: abs(z[1]-(z[2]/255.0::DOUBLE*2-1)))), 6) AS error FROM u"""
)
def fixed_q8(spark, sf):
    e = V.as_double("embedding")
    u = vectors(spark, sf).select("vec_id", e.alias("e"), V.quantize_fixed(e, 8).alias("u"))
    error = F.array_max(F.zip_with("e", V.dequantize_fixed(F.col("u"), 8), lambda x, y: F.abs(x - y)))
    return u.select("vec_id", F.aggregate("u", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), r6(error).alias("error"))


@query(_codec_sql(6) + " SELECT vec_id, round(list_max(list_transform(list_zip(e, u), lambda z: abs(z[1]-(z[2]-31)*scale))), 6) AS error, round(scale/2, 6) AS bound FROM u")
def dequant_error(spark, sf):
    e = V.as_double("embedding")
    rows = vectors(spark, sf).select("vec_id", e.alias("e"), V.quantize(e, 6).alias("q"))
    return rows.select("vec_id", r6(F.array_max(F.zip_with("e", V.dequantize(F.col("q")), lambda x, y: F.abs(x - y)))).alias("error"), r6(F.col("q.scale") / 2).alias("bound"))


@query(_codec_sql(4) + f", d AS (SELECT {cos('e', 'd')} AS c FROM (SELECT e, list_transform(u, lambda x: (x-7)*scale) AS d FROM u)) SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS most, round(stddev_pop(c), 6) AS deviation FROM d")
def codec_sweep(spark, sf):
    e = V.as_double("embedding")
    pairs = vectors(spark, sf).select(V.cosine(e, V.dequantize(V.quantize(e, 4))).alias("c"))
    return metrics.fidelity(pairs, "c").select(*(r6(c).alias(c) for c in ("mean", "least", "most", "deviation")))


@query(_codec_sql(6) + ", d AS (SELECT vec_id, 't'||label AS topic, list_transform(u, lambda x: (x-31)*scale) AS d FROM u JOIN embeddings USING (vec_id)), c AS (SELECT topic, pos, avg(d[pos]) AS x FROM d, range(1, 65) r(pos) GROUP BY ALL), cs AS (SELECT topic, (max(abs(x))+1e-9)/127 AS scale FROM c GROUP BY topic) SELECT topic, round(scale, 9) AS scale, sum(round_even(x/scale, 0)::INT+127)::BIGINT AS total FROM c JOIN cs USING (topic) GROUP BY topic, scale")
def quantized_centroids(spark, sf):
    rows = vectors(spark, sf).select("topic", V.quantize(V.as_double("embedding"), 6).alias("embedding_q"))
    t = ingest.topic_rows(rows)
    return t.select("topic", F.round("centroid_q.scale", 9).alias("scale"), F.aggregate("centroid_q.values", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH {VEC}, r AS (SELECT topic, e, row_number() OVER (PARTITION BY topic ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY topic) AS n FROM v) SELECT topic, pos-1 AS pos, round(sum(pow(0.95, n-i)*(CASE WHEN i = 1 THEN 1 ELSE 0.05 END)*e[pos]), 6) AS value FROM r, range(1, 65) p(pos) GROUP BY topic, pos")
def moving_centroids(spark, sf):
    return S.moving_centroids(vectors(spark, sf), "vec_id").select("topic", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


HASHED = """tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
 slot AS (SELECT doc_id, list_transform(w, lambda t: (('0x' || substr(md5(t), 1, 7))::BIGINT % 64)::INT) AS s FROM tok),
 cnt AS (SELECT doc_id, list_transform(range(0, 64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS c FROM slot)"""


@query(f"WITH {HASHED} SELECT doc_id, round(list_max(c)/(sqrt(list_dot_product(c, c))+1e-9), 6) AS most, round(c[6]/(sqrt(list_dot_product(c, c))+1e-9), 6) AS sixth FROM cnt")
def hashed_embeddings(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", V.embed_hashed(F.col("text")).alias("e"))
    return rows.select("doc_id", r6(F.array_max("e")).alias("most"), r6(F.get("e", 5)).alias("sixth"))


# --- columns and filters ------------------------------------------------------------------


@query(
    f"""SELECT doc_id, translate(source || './x', './\\', '___') AS file, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {NOW} + to_days((doc_id % 3)::INT) END AS ttl_ts, printf('%d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS clock,
    substr(sha1(doc_id::VARCHAR || '0' || substr(text, 1, 200)), 1, 16) AS chunk_id, round_even(n_chars/7.0, 3) AS ratio FROM documents"""
)
def derived_more(spark, sf):
    d = read(spark, sf, "documents")
    ttl = ingest.expiry(as_of(), F.col("doc_id") % 3).cast("timestamp_ntz")
    chunk_id = F.substring(F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit("0"), F.substring("text", 1, 200))), 1, 16)
    return d.select("doc_id", X.safe_name(F.concat("source", F.lit("./x"))).alias("file"), ttl.alias("ttl_ts"), X.clock(F.col("n_chars")).alias("clock"), chunk_id.alias("chunk_id"), F.bround(F.col("n_chars") / 7.0, 3).alias("ratio"))


@query(
    """SELECT count(*) FILTER (WHERE quality IS NULL) AS eq_null, count(*) FILTER (WHERE quality IS NOT NULL) AS ne_null, count(*) FILTER (WHERE coalesce(quality > 0, false)) AS gt, count(*) FILTER (WHERE coalesce(quality < 1, false)) AS lt,
    count(*) FILTER (WHERE coalesce(quality <= 0, false)) AS le, 0::BIGINT AS bad_between FROM documents LEFT JOIN labels USING (doc_id)"""
)
def filter_null_semantics(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    tests = {"eq_null": ("eq", None), "ne_null": ("ne", None), "gt": ("gt", 0), "lt": ("lt", 1), "le": ("le", 0), "bad_between": ("between", [1])}
    return rows.agg(*(F.count_if(filters.condition("quality", *t)).alias(n) for n, t in tests.items()))


@query(f"WITH {VEC} SELECT vec_id FROM v WHERE topic = 't3' AND quality >= 0.2 AND ts > TIMESTAMP '2024-01-01 01:00:00' AND ts < TIMESTAMP '2024-01-01 06:00:00'")
def filter_named(spark, sf):
    f = filters.Filters().topic_eq("t3").quality_ge(0.2).created_after(F.lit("2024-01-01 01:00:00").cast("timestamp")).created_before(F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return f.apply(vectors(spark, sf)).select("vec_id")


@query(f"WITH {VEC}, {MEM} SELECT vec_id FROM m WHERE topic = 't3' AND confidence >= 0.5 AND lang IN ('en', 'fr') ORDER BY ts DESC, vec_id LIMIT 20")
def newest_memories(spark, sf):
    rows = memories(spark, sf).withColumn("tags", F.array("lang"))
    return pipeline.find_memories(rows, 20, topic="t3", min_confidence=0.5, tags=["en", "fr"]).select("vec_id")


@query(f"WITH {VEC}, {MEM} SELECT vec_id, 0.5::DOUBLE AS score FROM m WHERE contains(lower(text), 'the%') OR contains(lower(text), 'the') ORDER BY confidence DESC, vec_id LIMIT 25")
def text_search(spark, sf):
    return pipeline.text_search(memories(spark, sf), "THE", 25).select("vec_id", "score")


@query(f"WITH {VEC}, {Q0} SELECT vec_id, round({cos('e', 'qe')}, 6) AS score FROM v, q WHERE vec_id % 7 = 0 ORDER BY {cos('e', 'qe')} DESC, vec_id LIMIT 10")
def search_allowed_ids(spark, sf):
    v = vectors(spark, sf)
    return pipeline.search_among(v, vector_of(spark, sf), 10, v.where(F.col("vec_id") % 7 == 0)).select("vec_id", r6("score").alias("score"))


@query(f"WITH {VEC}, {Q0}, b AS (SELECT vec_id, {cos('e', 'qe')} AS s FROM v, q ORDER BY s DESC, vec_id LIMIT 20) SELECT vec_id, round(s, 6) AS score FROM b WHERE vec_id % 2 = 0 ORDER BY s DESC, vec_id LIMIT 10")
def search_allowed_ids_late(spark, sf):
    v = vectors(spark, sf)
    return pipeline.search_among(v, vector_of(spark, sf), 10, v.where(F.col("vec_id") % 2 == 0), post_filter=True).select("vec_id", r6("score").alias("score"))


# --- retrieval ----------------------------------------------------------------------------

DOT = "list_dot_product(e, qe)"
STAGED = f"""WITH {VEC}, {Q0}, {CENT}, t AS (SELECT topic FROM c, q ORDER BY list_dot_product(c, qe) DESC, topic LIMIT 3), s AS (SELECT vec_id, topic, confidence, ts, {DOT} AS s FROM v, q),
 a AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, vec_id) AS r FROM s WHERE topic IN (FROM t)) WHERE r <= 20),
 b AS (SELECT vec_id FROM s ORDER BY s DESC, vec_id DESC LIMIT 40), x AS (SELECT * FROM s WHERE vec_id IN (FROM a UNION FROM b) ORDER BY s DESC, vec_id DESC LIMIT 20)"""


@query(STAGED + " SELECT vec_id, round(s, 6) AS score FROM x WHERE confidence >= 0.4 ORDER BY s DESC, vec_id DESC LIMIT 10")
def pipeline_multistage(spark, sf):
    found = pipeline.multistage(vectors(spark, sf), vector_of(spark, sf), 10, topics=3, newest=20, where=F.col("confidence") >= 0.4)
    return found.select("vec_id", r6("score").alias("score"))


@query(
    f"""WITH {VEC}, {MEM}, {Q0}, a AS (SELECT vec_id, {cos('e', 'qe')} AS s FROM m, q ORDER BY s DESC, vec_id LIMIT 20), b AS (SELECT vec_id, 0.5 AS w FROM m WHERE contains(lower(text), 'the') ORDER BY confidence DESC, vec_id LIMIT 20),
    j AS (SELECT vec_id, CASE WHEN s IS NULL THEN w WHEN w IS NULL THEN s ELSE s*(1-0.7)+w*0.7 END AS score FROM a FULL JOIN b USING (vec_id)) SELECT vec_id, round(score, 6)::DOUBLE AS score FROM j ORDER BY j.score DESC, vec_id LIMIT 10"""
)
def overlap_fusion(spark, sf):
    m = memories(spark, sf)
    found = pipeline.fuse("overlap", search.exact(m, vector_of(spark, sf), 20), pipeline.text_search(m, "the", 20), 10)
    return found.select("vec_id", r6("score").alias("score"))


@query(
    f"""WITH {_bm25_sql(ANALYZED.replace("documents", "documents JOIN embeddings ON vec_id = doc_id"), TERMS)}, {VEC}, {Q0}, kw AS (SELECT doc_id FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)
    SELECT vec_id, round({cos('e', 'qe')}, 6) AS score FROM v, q WHERE vec_id IN (FROM kw) AND confidence >= 0.4 ORDER BY {cos('e', 'qe')} DESC, vec_id LIMIT 10"""
)
def keyword_then_vector(spark, sf):
    found = pipeline.keyword_then_vector(memories(spark, sf), TERMS, vector_of(spark, sf), 10, 50, F.col("confidence") >= 0.4)
    return found.select("vec_id", r6("score").alias("score"))


@query(f"WITH {_bm25_sql(ANALYZED, TERMS)} SELECT DISTINCT term, round(ln((n-df+0.5)/(df+0.5)+1), 6) AS idf FROM df, st WHERE df > 0 ORDER BY 2 DESC, term LIMIT 3")
def relevant_terms(spark, sf):
    return pipeline.relevant_terms(read(spark, sf, "documents"), TERMS, 3).select("term", r6("idf").alias("idf"))


def _thresholds_sql() -> str:
    n = "CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score-min(score) OVER ())/(max(score) OVER ()-min(score) OVER ()) END"
    return (
        FUSE
        + f""", {DOC}, a AS (SELECT doc_id, {n} AS s FROM vs), b AS (SELECT doc_id, {n} AS s FROM kw), j AS (SELECT doc_id, coalesce(a.s, 0) AS v, coalesce(b.s, 0) AS k FROM a FULL JOIN b USING (doc_id)),
    z AS (SELECT doc_id, CASE WHEN v < 0.3 THEN 0 ELSE v END AS v, CASE WHEN k < 0.2 THEN 0 ELSE k END AS k, CASE WHEN ts IS NULL THEN 0.5 ELSE greatest(0, least(1, exp(-0.023*(epoch({NOW})-epoch(ts))/86400))) END AS r FROM j LEFT JOIN d USING (doc_id))"""
    )


def _explained(spark, sf):
    kw, vs = _lists(spark, sf)
    fused = search.weighted_fusion(vs, kw, texts(spark, sf), as_of(), least_vector=0.3, least_keyword=0.2)
    return pipeline.explain_scores(fused, search.WEIGHTS)


@query(_thresholds_sql() + " SELECT doc_id, round_even(0.6*v+0.3*k+0.1*r, 4) AS final_score, round_even(v, 4)::DOUBLE AS vector_score, round_even(0.3*k, 4) AS keyword_contribution, 0.1::DOUBLE AS recency_weight FROM z")
def explain_scores(spark, sf):
    x = _explained(spark, sf)
    return x.select("doc_id", "final_score", F.col("vector.score").alias("vector_score"), F.col("keyword.contribution").alias("keyword_contribution"), F.col("recency.weight").alias("recency_weight"))


@query(_thresholds_sql() + " SELECT doc_id, length(printf('score %.4f; vector: %.4f x 0.60 = %.4f; keyword: %.4f x 0.30 = %.4f; recency: %.4f x 0.10 = %.4f; confidence: %.4f x 0.00 = %.4f', 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)) AS n FROM z")
def explanation_lines(spark, sf):
    return pipeline.explanation(_explained(spark, sf), search.WEIGHTS).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"WITH {VEC}, {Q0}, h AS (SELECT vec_id, {DOT} AS s FROM v, q WHERE vec_id % 2 = 0 ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, topic, round(s, 6) AS score FROM h JOIN v USING (vec_id)")
def hits_with_metadata(spark, sf):
    v = vectors(spark, sf)
    hits = search.exact(v.where(F.col("vec_id") % 2 == 0), vector_of(spark, sf), 10, V.dot).select("vec_id", "score")
    return pipeline.hits_with_metadata(hits, v.select("vec_id", "topic")).select("vec_id", "topic", r6("score").alias("score"))


@query(f"WITH {VEC} SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, {cos('a.e', 'b.e')} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({cos('a.e', 'b.e')}, 9) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.vec_id % 3 <> 0) WHERE r <= 5")
def batch_topk_without(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    left = logs.remove(v, v.where(F.col("vec_id") % 3 == 0), "vec_id")
    return search.batch_topk(v.where(F.col("vec_id") % 20 == 0), left, 5).select("query_id", "vec_id", r6("score").alias("score"))


@query()
def ivf_recall(spark, sf):
    """Recall of ivf_search against exact search, for every vector whose id is divisible by 20."""
    v = read(spark, sf, "embeddings")
    return search.ivf_recall(v, search.kmeans_lists(v, 16), v.where(F.col("vec_id") % 20 == 0), 10, PROBES)


# --- maintenance --------------------------------------------------------------------------


def _chunks(spark, sf, embedding=True):
    rows = memories(spark, sf, embedding).withColumns({"entropy": X.entropy(F.col("text")), "source_refs": F.array("source")})
    return rows.select("topic", "vec_id", "seq", "text", "confidence", "staleness", "entropy", "ts", "source_refs", *["embedding"][:embedding])


RESOLVED = f"""WITH {VEC}, {MEM}, f AS (SELECT vec_id, topic, {FEATURES} FROM (SELECT *, lower(text) AS t FROM m)),
 hit AS (SELECT DISTINCT a.vec_id FROM f a JOIN f b ON a.topic = b.topic AND a.vec_id < b.vec_id WHERE a.negs <> b.negs AND len(list_intersect(a.w, b.w)) >= 3),
 rs AS (SELECT m.* REPLACE (CASE WHEN hit.vec_id IS NULL THEN confidence ELSE confidence*0.5 END AS confidence, CASE WHEN hit.vec_id IS NULL THEN staleness ELSE least(1.0, staleness+0.3) END AS staleness) FROM m LEFT JOIN hit USING (vec_id))"""


@query(RESOLVED + " SELECT vec_id, round(confidence, 6)::DOUBLE AS confidence, round(staleness, 6)::DOUBLE AS staleness FROM rs")
def resolve_contradictions(spark, sf):
    return maintain.resolve_contradictions(_chunks(spark, sf, False)).select("vec_id", r6("confidence").alias("confidence"), r6("staleness").alias("staleness"))


@query(
    RESOLVED
    + f""", p AS (SELECT * FROM rs WHERE least(1.0, length(text)/500) >= 0.10 AND staleness <= 0.90), ab AS (SELECT vec_id, topic, confidence, text AS old, {_absolute_sql()} AS t FROM p),
    ac AS (SELECT vec_id, topic, confidence, old, upper(t[1]) || t[2:] AS t FROM ab), u AS (SELECT *, row_number() OVER (PARTITION BY topic, sha1(t) ORDER BY vec_id) AS r FROM ac),
    k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, vec_id) AS k FROM u WHERE r = 1) SELECT vec_id, topic, round(confidence, 6)::DOUBLE AS confidence, md5(t) AS digest, t <> old AS rewritten FROM k WHERE k <= 300"""
)
def consolidate_without_merge(spark, sf):
    done = maintain.consolidate(_chunks(spark, sf, False), threshold=1.0)
    return done.select("vec_id", "topic", r6("confidence").alias("confidence"), F.md5("text").alias("digest"), "rewritten")


@query()
def consolidate_topic(spark, sf):
    """The whole chain with its totals; the greedy merge within it is tested against a plain version."""
    chunks = _chunks(spark, sf)
    return maintain.consolidation_report(chunks, maintain.consolidate(chunks))


ADDED = f"""{_reason_sql().replace("doc_id, source, trim", "conv_id, turn, topic, text, trim").replace("FROM documents", "FROM (SELECT conv_id, turn, 'c'||conv_id AS topic, text FROM conversations)").replace("SELECT doc_id, CASE", "SELECT conv_id, turn, topic, text, CASE").replace("lower(source)", "lower(topic)")},
 x AS (SELECT topic, turn AS seq, text, turn > 0 AS added FROM r WHERE turn = 0 OR reason IS NULL),
 f AS (SELECT topic, seq, added, {FEATURES} FROM (SELECT *, lower(text) AS t FROM x)), n AS (SELECT a.topic, a.seq, count(*) AS n FROM f a JOIN f b ON a.topic = b.topic AND a.seq < b.seq AND b.added WHERE {CONTRADICTS} GROUP BY ALL)"""


@query(
    f"""WITH {ADDED} SELECT topic, printf('c%04d', row_number() OVER (PARTITION BY topic ORDER BY seq)) AS chunk_id, added, md5(text) AS digest, round(0.9*pow(0.6, coalesce(n, 0)), 6) AS confidence,
    round(least(1.0, 0.25*coalesce(n, 0)), 6)::DOUBLE AS staleness, round(least(1.0, length(text)/500), 6)::DOUBLE AS entropy, CASE WHEN added AND seq % 2 = 1 THEN {NOW} + to_days(1) END AS ttl_ts FROM x LEFT JOIN n USING (topic, seq)"""
)
def add_memory(spark, sf):
    """First turns are the store, the others come in; conversations are topics."""
    turns = read(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("topic"), F.col("turn").alias("seq"), "text", F.lit(0.9).alias("confidence"))
    first = turns.where("seq = 0").withColumns({"chunk_id": F.lit("c0001"), "staleness": F.lit(0.0), "text_hash": F.sha1("text"), "entropy": X.entropy(F.col("text")), "ts": as_of(), "ttl_ts": F.lit(None).cast("timestamp"), "embedding_q": V.quantize(V.embed_hashed(F.col("text")), 6)})
    items = turns.where("seq > 0").withColumn("ttl_days", F.col("seq") % 2)
    done = ingest.add_memories(first, items, as_of())
    return done.select("topic", "chunk_id", "added", F.md5("text").alias("digest"), r6("confidence").alias("confidence"), r6("staleness").alias("staleness"), r6("entropy").alias("entropy"), F.col("ttl_ts").cast("timestamp_ntz").alias("ttl_ts"))


@query(f"WITH {ADDED.split(',' + chr(10) + ' x AS')[0]} SELECT coalesce(reason, 'stored') AS reason, count(*) AS n FROM r GROUP BY 1")
def exclusion_summary(spark, sf):
    turns = read(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("topic"), "text")
    return ingest.split_excluded(turns).groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t)-1200)/1000))::BIGINT + 1)) AS pos FROM t WHERE t <> ''),
    c AS (SELECT doc_id, pos, trim(substr(t, pos*1000+1, 1200), ' ' || chr(9) || chr(10) || chr(13)) AS c FROM p), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY pos) AS r FROM c WHERE c <> '')
    SELECT doc_id, pos, substr(sha1(doc_id::VARCHAR || pos::VARCHAR || substr(c, 1, 200)), 1, 16) AS chunk_id, '0' AS topic, CASE WHEN length(c) > 30 THEN 0.85::DOUBLE ELSE 0.55 END AS confidence FROM u WHERE r = 1"""
)
def etl(spark, sf):
    rows = ingest.etl(read(spark, sf, "documents"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk_id", "topic", "confidence")


@query(f"WITH {VEC} SELECT vec_id, CASE WHEN topic = 't1' THEN 0.01::DOUBLE ELSE confidence END AS confidence FROM v")
def forget_topic(spark, sf):
    return maintain.forget(vectors(spark, sf), F.col("topic") == "t1").select("vec_id", "confidence")


@query("SELECT CASE WHEN contains(t, 'invoice') OR contains(t, 'amount due') OR contains(t, 'iban') THEN 'invoice' WHEN contains(t, 'contract') OR contains(t, 'agreement') THEN 'contract' WHEN contains(t, 'meeting') OR contains(t, 'agenda') THEN 'meeting_notes' WHEN contains(t, 'error') OR contains(t, 'exception') THEN 'log' ELSE 'generic_text' END AS kind, count(*) AS n FROM (SELECT lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))[1:5200]) AS t FROM documents) GROUP BY 1")
def schema_of_documents(spark, sf):
    return read(spark, sf, "documents").select(X.schema_of_chunks(F.col("text")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM (" + SQL["quality_score"] + ")) WHERE flag <> '' GROUP BY flag")
def quality_flags(spark, sf):
    q = X.quality(F.col("text"), F.col("confidence"), F.col("staleness"), F.col("verified"), F.col("quality"))
    return texts(spark, sf).select(F.explode(q["flags"]).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


# --- logs and side tables -----------------------------------------------------------------


@query(f"WITH {VEC} SELECT 'prune' AS operation, topic, vec_id FROM v WHERE staleness > 0.9 ORDER BY ts DESC, topic, vec_id LIMIT 15")
def audit_log(spark, sf):
    gone = vectors(spark, sf).where("staleness > 0.9")
    log = logs.audit_rows(gone, "prune", F.col("ts"), "vec_id")
    found = logs.latest_logs(log, 15, "prune")
    return found.select("operation", "topic", F.get_json_object("details", "$.vec_id").cast("long").alias("vec_id"))


@query("SELECT user_id, count(*) AS accesses, max(event_id) AS last FROM events WHERE event_type = 'view' GROUP BY user_id")
def access_counts(spark, sf):
    rows = events(spark, sf).where("event_type = 'view'")
    counts = logs.access_counts(rows, "user_id").select("user_id", "accesses")
    return counts.join(rows.groupBy("user_id").agg(F.max("event_id").alias("last")), "user_id")


@query("SELECT DISTINCT CASE WHEN vec_id = 12 THEN vec_id // 2 ELSE vec_id END AS other, CASE WHEN vec_id % 2 = 0 THEN 'contradicts' ELSE 'supports' END AS kind FROM embeddings WHERE (vec_id = 12 OR vec_id // 2 = 12) AND vec_id % 2 = 0")
def edges_of(spark, sf):
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), F.expr("vec_id div 2").alias("b"), F.when(F.col("vec_id") % 2 == 0, "contradicts").otherwise("supports").alias("kind"))
    return logs.edges_of(rows, 12, "contradicts")


@query(f"WITH {VEC} SELECT count(*) AS memories, round(avg(confidence), 6) AS avg_confidence, round(avg(quality), 6) AS avg_importance, count(DISTINCT topic) AS topics, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS contradictions FROM v")
def memory_statistics(spark, sf):
    v = vectors(spark, sf).withColumn("importance", F.col("quality"))
    kinds = v.select(F.when(F.col("vec_id") % 2 == 0, "contradicts").otherwise("supports").alias("kind"))
    found = metrics.memory_statistics(v, kinds)
    return found.select("memories", r6("avg_confidence").alias("avg_confidence"), r6("avg_importance").alias("avg_importance"), "topics", "contradictions")


@query("SELECT count(*) AS vectors, count(*)*48 AS bytes, round(64*4/48.0, 6)::DOUBLE AS ratio FROM embeddings WHERE vec_id % 10 <> 0")
def vector_store(spark, sf):
    folder = scratch_folder(spark, "vectors")
    v = vectors(spark, sf).select("vec_id", "embedding")
    store.export_quantized(logs.remove(v, v.where(F.col("vec_id") % 10 == 0), "vec_id"), folder)
    return logs.vector_store_statistics(spark.read.parquet(folder)).select("vectors", "bytes", r6("ratio").alias("ratio"))


@query(_codec_sql(6) + " SELECT vec_id, round(list_sum(list_transform(u, lambda x: (x-31)*scale)), 6) AS total FROM u")
def quantized_export(spark, sf):
    folder = scratch_folder(spark, "quantized")
    store.export_quantized(vectors(spark, sf).select("vec_id", "embedding"), folder)
    back = store.unpacked(spark.read.parquet(folder))
    return back.select("vec_id", r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"WITH {VEC} SELECT vec_id, topic, round(confidence, 6)::DOUBLE AS confidence FROM v")
def segments_compacted(spark, sf):
    """Segments written twice, the second time with newer rows, and compacted."""
    v = vectors(spark, sf).select("vec_id", "topic", "confidence", "ts")
    old, new = scratch_folder(spark, "segments"), scratch_folder(spark, "compact")
    logs.write_segments(v.withColumns({"confidence": F.lit(0.0), "ts": F.col("ts") - F.expr("interval 1 day")}), old, 3)
    logs.write_segments(v, old, 3)
    return logs.compact_segments(spark, old, new, 2).select("vec_id", "topic", r6("confidence").alias("confidence"))


@query(f"WITH {VEC}, {MEM}, b AS (SELECT topic, text, row_number() OVER (PARTITION BY topic ORDER BY confidence DESC, vec_id) AS r FROM m) SELECT topic, '- ' || topic || ': ' || substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 100) AS line FROM b WHERE r = 1")
def memory_index_small(spark, sf):
    """Few topics: all lines fit, so all stay, though the limit is lower than their number."""
    return store.memory_index(memories(spark, sf), lines=2)


@query("SELECT DISTINCT lang AS value FROM documents WHERE lang IS NOT NULL")
def distinct_values(spark, sf):
    return logs.distinct_values(read(spark, sf, "documents"), "lang").withColumnRenamed("lang", "value")


@query(f"WITH {VEC} SELECT topic, count(*) AS chunks FROM v WHERE topic = 't4' GROUP BY topic")
def exported_topic(spark, sf):
    rows = store.export_topic(vectors(spark, sf), "t4")
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT vec_id, 0.5::DOUBLE AS confidence, false AS verified, NULL::VARCHAR AS source FROM embeddings")
def migrated_store(spark, sf):
    return logs.migrate(read(spark, sf, "embeddings").select("vec_id"), 0).select("vec_id", "confidence", "verified", "source")


@query(f"WITH {VEC} SELECT 'topics' AS part, count(DISTINCT topic) AS n FROM v UNION ALL SELECT 'health', count(DISTINCT topic) FROM v")
def report_json(spark, sf):
    v = vectors(spark, sf)
    parts = {"topics": v.groupBy("topic").agg(F.count(F.lit(1)).alias("n")), "health": metrics.topic_health(v)}
    rows = logs.report(parts)
    return rows.select("part", F.json_array_length("json").cast("long").alias("n"))


@query(f"WITH {VEC} SELECT max(ts) FILTER (WHERE vec_id % 2 = 0) AS last_consolidation, sum(vec_id) FILTER (WHERE vec_id % 2 = 1)::BIGINT AS pruned FROM v")
def maintenance_metrics(spark, sf):
    log = vectors(spark, sf).select("ts", F.when(F.col("vec_id") % 2 == 0, "consolidate").otherwise("prune").alias("action"), "topic", F.col("vec_id").alias("chunks_affected"))
    return metrics.maintenance_metrics(log).select(F.col("last_consolidation").cast("timestamp_ntz").alias("last_consolidation"), "pruned")


# --- events -------------------------------------------------------------------------------


@query("SELECT count(*) AS events, count(DISTINCT event_type) AS kinds, min(event_id) AS first_id, max(event_id) AS last_id FROM events")
def log_statistics(spark, sf):
    return E.log_statistics(events(spark, sf)).drop("last_ts")


@query("SELECT event_id FROM events WHERE user_id = 3 AND ts > TIMESTAMP '2024-01-20'")
def events_by_topic(spark, sf):
    return E.after(E.by_topic(events(spark, sf), "user_id", 3), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT event_id FROM events WHERE event_id > 100 AND event_id <= 900 AND event_type IN ('view', 'click')")
def pull_filtered(spark, sf):
    return S.pull(events(spark, sf), 100, 900, ["view", "click"], "event_type").select("event_id")


@query("SELECT event_id, event_type FROM events")
def replicate_rows(spark, sf):
    """Every event once, with its values, after two exchanges with an overlapping remote."""
    e = events(spark, sf).withColumn("origin", F.lit("a"))
    folder = scratch_folder(spark, "log")
    E.export_log(e.where(F.col("event_id") % 3 != 1), folder)
    once = E.import_log(spark, folder, e.where(F.col("event_id") % 3 != 0))
    return E.import_log(spark, folder, once).select("event_id", "event_type")


@query("SELECT (SELECT count(*) FROM events WHERE event_id < 500 OR event_id > 400) AS events, (SELECT max(event_id) FROM events) AS mark")
def sync_high_water(spark, sf):
    e = events(spark, sf).withColumn("origin", F.lit("a"))
    marks = spark.createDataFrame([("peer", 400)], "remote string, event_id long")
    local = e.where("event_id < 500")
    for _ in range(2):  # the second pull finds nothing new
        local, marks = S.synchronise(local, e, marks, "peer")
    return local.agg(F.count(F.lit(1)).alias("events")).crossJoin(marks.agg(F.max("event_id").alias("mark")))


@query("SELECT 'done' AS status, count(*) FILTER (WHERE event_type <> 'view') AS n FROM events UNION ALL SELECT 'failed', count(*) FILTER (WHERE event_type = 'view') FROM events")
def replay_counted(spark, sf):
    def handler(kind):
        if kind == "view":
            raise ValueError(kind)

    return S.replay_counted(events(spark, sf), handler, "event_type")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS hits FROM events GROUP BY 1, 2")
def stream_hot(spark, sf):
    folder = scratch_folder(spark, "hot")
    found = E.run_to_table(S.hot_stream(E.stream_events(spark, sf), "event_type"), f"{folder}/out", f"{folder}/checkpoint", "complete")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "hits")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_periodic(spark, sf):
    """A maintenance job on each micro-batch: here it keeps the accesses of each key."""
    folder = scratch_folder(spark, "periodic")

    def job(batch):
        batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{folder}/out")

    S.periodically(E.stream_events(spark, sf), job, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.sum("n").alias("n"))


@query()
def recent_duplicates(spark, sf):
    """Documents of each source whose hash is not within 6 bits of one of the last 300 that were kept."""
    rows = read(spark, sf, "documents").select("source", "doc_id", F.xxhash64("text").alias("hash"))
    return S.drop_recent_duplicates(rows, "source", "doc_id", "hash")


@query()
def scene_changes(spark, sf):
    return S.scene_changes(events(spark, sf), "user_id", "event_id", "value", 20.0, 2)


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k")
def event_sessions(spark, sf):
    return E.sessions(events(spark, sf)).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# --- more of the store --------------------------------------------------------------------


@query(f"WITH {DOC} SELECT doc_id, round(greatest(0, least(1, exp(-0.023*(epoch({NOW})-epoch(ts))/86400))), 6) AS good, 0.5::DOUBLE AS bad FROM d")
def recency_of_text(spark, sf):
    """Times as text, with a Z for UTC; what can't be read counts as half."""
    rows = texts(spark, sf).withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return rows.select("doc_id", r6(search.recency(X.iso_time(F.col("iso")), as_of())).alias("good"), r6(search.recency(X.iso_time(F.concat(F.lit("x"), "iso")), as_of())).alias("bad"))


@query(f"WITH {VEC} SELECT topic, vec_id, 'src' || topic AS source, substr(sha1('m' || vec_id::VARCHAR), 1, 16) AS memory_id, len(['a', topic])::BIGINT AS n_tags, round(confidence, 6)::DOUBLE AS importance FROM v WHERE vec_id % 4 = 0")
def tagged_memories(spark, sf):
    rows = vectors(spark, sf).where("vec_id % 4 = 0").withColumns({"source": F.concat(F.lit("src"), "topic"), "name": F.concat(F.lit("m"), "vec_id")})
    added = ingest.memory_rows(rows, tags=F.array(F.lit("a"), "topic"), agent=F.lit("tests"), importance=F.col("confidence"), name=F.col("name"))
    return added.select("topic", "vec_id", "source", "memory_id", F.size("tags").cast("long").alias("n_tags"), r6("importance").alias("importance"))


@query(f"WITH {VEC} SELECT vec_id, topic, round(e[1], 6) AS first FROM v WHERE vec_id IN (3, 5, 8)")
def vectors_by_key(spark, sf):
    v = vectors(spark, sf)
    return pipeline.hits_with_metadata(v.where(F.col("vec_id").isin(3, 5, 8)).select("vec_id", "embedding"), v.select("vec_id", "topic")).select("vec_id", "topic", r6(F.get("embedding", 0).cast("double")).alias("first"))


@query()
def cluster_topics(spark, sf):
    """Every vector with the nearest of 8 centroids that are fitted on a bounded sample."""
    v = read(spark, sf, "embeddings")
    return search.with_list(v, search.kmeans_lists(v, 8)).select("vec_id", F.col("bucket").alias("cluster"))


@query(f"WITH {_bm25_sql(ANALYZED, TERMS)} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')) ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_topics(spark, sf):
    docs = read(spark, sf, "documents")
    found = search.only(search.bm25(docs, TERMS), docs.where(F.col("source").isin("src1", "src2")))
    return search.topk(found, 20, key="doc_id").select("doc_id", r6("score").alias("score"))


@query(f"WITH {_bm25_sql(ANALYZED, TERMS)} SELECT doc_id, round(score, 6) AS score FROM bm WHERE doc_id = 7")
def bm25_one_document(spark, sf):
    docs = read(spark, sf, "documents")
    return search.only(search.bm25(docs, TERMS, keep_zero=True), docs.where("doc_id = 7")).select("doc_id", r6("score").alias("score"))


@query(f"WITH {ANALYZED} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY ALL")
def term_frequencies(spark, sf):
    return search.term_frequencies(read(spark, sf, "documents"))


@query(
    FUSE
    + """, a AS (SELECT doc_id, 1.0/(60+row_number() OVER (ORDER BY score DESC, doc_id)-1) AS p FROM (SELECT * FROM kw ORDER BY score DESC, doc_id LIMIT 40)),
    b AS (SELECT doc_id, 1.0/(60+row_number() OVER (ORDER BY score DESC, doc_id)-1) AS p FROM (SELECT * FROM vs ORDER BY score DESC, doc_id LIMIT 40))
    SELECT doc_id, round(sum(p), 6) AS score FROM (FROM a UNION ALL FROM b) GROUP BY doc_id HAVING sum(p) >= 0.0125"""
)
def rrf_min_score(spark, sf):
    return search.rrf(_lists(spark, sf), 40, min_score=0.0125).select("doc_id", r6("score").alias("score"))


@query(f"WITH {DOC}, f AS (SELECT topic, doc_id AS seq, {FEATURES} FROM (SELECT *, lower(text) AS t FROM d)) SELECT a.topic, a.seq AS older, b.seq AS newer FROM f a JOIN f b ON a.topic = b.topic AND a.seq < b.seq WHERE {CONTRADICTS}")
def document_contradictions(spark, sf):
    return maintain.contradiction_pairs(texts(spark, sf))
