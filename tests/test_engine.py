"""Operators that SQL can't check, against plain versions; and what has no query."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram import plugins, session
from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import contradictions, ingest, maintain, metrics, pipeline, search
from engram.plans import QUERIES
from engram.sources import logs, store
from engram.streaming import events as E
from engram.streaming import stateful as S

SF = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def test_leader_merge_against_plain(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(f"t{i % 2}", i, (centres[i % 6] + 0.25 * rng.normal(size=8)).tolist()) for i in range(120)]
    got = {r.vec_id: r.leader for r in maintain.leader_merge(spark.createDataFrame(rows, "topic string, vec_id long, embedding array<double>")).collect()}
    expected, leaders = {}, defaultdict(list)
    for topic, i, e in rows:
        v = np.array(e) / (np.linalg.norm(e) + 1e-9)
        own = next((j for j, w in leaders[topic] if w @ v >= 0.85), None)
        expected[i] = i if own is None else own
        if own is None:
            leaders[topic].append((i, v))
    assert got == expected and len(set(got.values())) < 120


def test_merged_and_consolidated(spark):
    vague = "I think the river is roughly wide"
    rows = [
        ("t", 1, 1, "the old river runs past the mill and the town below it every day", 0.5, 0.1, 0.9, ["a"], [1.0, 0.0]),
        ("t", 2, 2, vague, 0.9, 0.1, 0.9, ["b", "a"], [1.0, 0.01]),
        ("t", 3, 3, "short", 0.9, 0.1, 0.01, ["c"], [0.0, 1.0]),
        ("t", 4, 4, "stale text", 0.9, 0.95, 0.9, ["c"], [0.0, 1.0]),
        ("u", 5, 5, "alone", 0.4, 0.0, 0.9, ["d"], [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "topic string, vec_id long, seq long, text string, confidence double, staleness double, entropy double, source_refs array<string>, embedding array<double>").withColumn("ts", F.timestamp_seconds(F.col("seq") * 100))
    done = maintain.consolidate(df)
    got = {r.topic: r for r in done.collect()}
    assert set(got) == {"t", "u"} and got["t"].vec_id == 2 and got["t"].members == 2
    assert got["t"].confidence == pytest.approx(0.7) and got["t"].source_refs == ["a", "b"] and got["t"].ts.timestamp() == 100
    assert got["t"].text == spark.range(1).select(X.make_absolute(F.lit(vague))).first()[0] != vague
    report = {r.topic: r.asDict() for r in maintain.consolidation_report(df, done).collect()}
    assert report["t"] == {"topic": "t", "before": 4, "after": 1, "removed": 3, "merged": 1, "absolute": 0}
    assert [r.topic for r in maintain.cap(df, 1).orderBy("topic").collect()] == ["t", "u"]


def test_contradiction_flips_verification(spark):
    rows = [(1, "a", "the bridge is 30 meters long", [1.0, 0.0]), (2, "a", "the bridge is 60 meters long", [0.1, 1.0]), (3, "b", "some other text", [1.0, 1.0]), (4, "c", "one more text", [1.0, 1.0]), (5, "d", "the tower is tall", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, topic string, text string, embedding array<double>")
    got = {r.vec_id: r for r in search.verify(df, df, [1.0, 0.0]).collect()}
    assert not got[1].verified and got[1].contradicted and got[1].flags == ["contradiction_detected"]
    for k, rest in ((1, 0.0), (5, 0.2)):
        assert got[k].verification == pytest.approx(0.5 * got[k].agreement + 0.3 + rest)
    assert got[5].verified and got[5].flags == []
    calm = df.where("vec_id <> 2")
    assert {r.vec_id: r.verified for r in search.verify(calm, calm, [1.0, 0.0]).collect()}[1]


def test_contradictions_of_a_large_topic(spark, monkeypatch):
    rows = [("t" if i % 7 else "u", i, f"the limit is {i % 5 * 10} units") for i in range(80)]
    df = spark.createDataFrame(rows, "topic string, seq long, text string")
    whole = sorted(map(tuple, maintain.contradiction_pairs(df).collect()))
    expected = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[1] % 5 != b[1] % 5)
    monkeypatch.setattr(maintain, "PART", 10)
    assert whole == expected == sorted(map(tuple, maintain.contradiction_pairs(df).collect()))


def plain_contradictions(rows, negations, whole):
    def of(text):
        t = text.lower()
        numbers = [float(x) for x in re.findall(r"\b\d+\.?\d*\b", t, re.ASCII)]
        return numbers, any(w in t for w in negations), {w for w in t.split() if len(w) > 3}, {d for d in re.findall(X.DATE, t, re.ASCII)}

    out, found = [], [(topic, seq, *of(text)) for topic, seq, text in rows if text is not None]
    for (t, i, n, g, w, d), (u, j, m, h, v, e) in itertools.permutations(found, 2):
        if t == u and t is not None and i < j:
            far = any(not abs(x - y) / (max(x, y) + 1e-9) <= 0.1 for x in n for y in m)  # NaN is the largest
            if (g != h and len(w & v) >= 3) or whole and (far or d and e and d != e and len(w & v) >= 2):
                out.append((t, i, j))
    return sorted(out)


def test_contradictions_in_blocks_against_plain(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"{a}{b}ra" for a in ("bri", "tel", "mas", "dro", "élu") for b in ("ge", "mi", "sta")]

    def text():
        words = rng.choices(names, weights=range(1, 16), k=rng.randrange(8))
        words += rng.choices(["never", "2024-01-05", "2024-02-07", "05/06/2023", "12", "12.5", "400", "9" * 400], k=1) if rng.random() < 0.5 else []
        return " \n".join(rng.sample(words, len(words)))

    rows = [(rng.choice(["big", "big", "large", "tiny", None]), i, None if i % 50 == 0 else text()) for i in range(300)]
    rows += [("few", 1000, "brigera telmira masstara"), ("few", 1001, "brigera telmira masstara never"), ("few", 1002, "")]
    df = spark.createDataFrame(rows, "topic string, seq int, text string").repartition(3)
    monkeypatch.setattr(maintain, "SMALL", 3)
    for part in (16, 4096):
        monkeypatch.setattr(maintain, "PART", part)
        got = maintain.contradiction_pairs(df)
        assert got.dtypes == [("topic", "string"), ("older", "int"), ("newer", "int")]
        expected = plain_contradictions(rows, X.NEGATIONS, True)
        assert sorted(map(tuple, got.collect())) == expected and {p[0] for p in expected} == {"big", "large", "tiny", "few"}
        late = maintain.contradiction_pairs(df, newer=F.col("seq") % 3 == 0)
        assert sorted(map(tuple, late.collect())) == [p for p in expected if p[2] % 3 == 0]
        marked = df.withColumns({"confidence": F.lit(1.0), "staleness": F.lit(0.9)})
        done = {(r.topic, r.seq): (r.confidence, r.staleness) for r in maintain.resolve_contradictions(marked).collect()}
        hit = {p[:2] for p in plain_contradictions(rows, X.NEGATIONS_SHORT, False)}
        assert done == {(t, i): (0.5, 1.0) if (t, i) in hit else (1.0, 0.9) for t, i, _ in rows} and hit


def test_counts_of_shared_words(monkeypatch):
    rng = random.Random(6)
    left, right = ([{f"w{int(30 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 9))} for _ in range(n)] for n in (23, 17))
    for cells, dense in ((1, 1 / 256), (60, 0.1), (60, 2.0), (1 << 22, 0.1)):
        monkeypatch.setattr(contradictions, "CELLS", cells)
        monkeypatch.setattr(contradictions, "DENSE", dense)
        found = list(contradictions._shared(*(pa.chunked_array([[" ".join(sorted(w)) for w in side]]) for side in (left, right))))
        assert [first for first, _ in found] == list(np.cumsum([0] + [len(c) for _, c in found[:-1]]))
        assert np.concatenate([c for _, c in found]).tolist() == [[len(a & b) for a in left] for b in right]


def test_search_for_newer_contradictions_against_plain(monkeypatch):
    rng = random.Random(9)
    names = [a + b for a in ("brig", "ÀÉ", "🙂x") for b in ("era", "ib", "🙂🙂")]

    def text():
        words = rng.choices(names, weights=range(1, 10), k=rng.randrange(9)) + ["never"] * rng.randrange(2) + ["x"] * rng.randrange(2)
        return rng.choice([" ", " \n", "\x0b\t"]).join(words) + rng.choice(["", " "])

    topics = ["a"] * 90 + ["b"] * 4 + ["c"] * 2 + ["d"] * 60 + ["e"]
    rows = [(t, i - 60 if i else -(1 << 63), text()) for i, t in zip(rng.sample(range(len(topics)), len(topics)), topics, strict=True)]
    lowered = [x.lower() for _, _, x in rows]
    given = {"topic": [t for t, *_ in rows], "kind": [contradictions.NEGATION] * len(rows), "i": [0] * len(rows), "j": [0] * len(rows), "seq": [s for _, s, _ in rows], "neg": ["never" in x for x in lowered], "words": lowered}
    expected = sorted({p[:2] for p in plain_contradictions(rows, ["never"], False)})
    assert 20 < len(expected) < len(rows) - 20
    for together, first, size in ((1, 1, 7), (8, 3, 50), (100, 2, 1000), (1024, 64, 1000)):
        monkeypatch.setattr(contradictions, "TOGETHER", together)
        monkeypatch.setattr(contradictions, "FIRST", first)
        shorter = contradictions._long_words(iter(pa.table(given).to_batches(max_chunksize=size)))
        found = [b.to_pydict() for b in contradictions._contradicted(shorter)]
        assert sorted((t, s) for b in found for t, s in zip(b["topic"], b["older"], strict=True)) == expected


def test_search_for_newer_contradictions_ends_early(monkeypatch):
    n, seen, whole = 4000, [], contradictions._counts
    words = ["brigera telmira masstara " + " ".join(f"word{(i * 7 + k) % 900}" for k in range(40)) for i in range(n)]
    rows = pa.table({"topic": ["t"] * n, "kind": [1] * n, "i": [0] * n, "j": [0] * n, "seq": range(n), "neg": [i % 2 == 0 for i in range(n)], "words": words})
    monkeypatch.setattr(contradictions, "_counts", lambda codes, row, left, right: seen.append(left * right) or whole(codes, row, left, right))
    found = [s for b in contradictions._contradicted(iter(rows.to_batches())) for s in b["older"].to_pylist()]
    assert sorted(found) == list(range(n - 1)) and sum(seen) < n * n / 4 / 8


def scans_of_texts(df):
    return len(re.findall(r"FileScan parquet \[[^\]]*\btext#", df._jdf.queryExecution().executedPlan().toString()))


def test_resolving_reads_texts_once(spark, monkeypatch):
    done = QUERIES["resolve_contradictions"](spark, SF)
    assert scans_of_texts(done) == 1
    monkeypatch.setattr(session, "FEW", 0)
    shuffled = QUERIES["resolve_contradictions"](spark, SF)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, done.collect()))


def test_resolving_without_topic_seq_or_text(spark):
    rows = [("t", 1, "brigera telmira masstara"), ("t", 2, "brigera telmira masstara never"), (None, 1, "brigera telmira masstara"), ("t", None, "brigera telmira masstara"), ("t", 3, None)]
    own = {"confidence": F.lit(1.0), "staleness": F.lit(0.0)}
    for kind in ("int", "string"):
        df = spark.createDataFrame(rows, "topic string, seq int, text string").withColumn("seq", F.col("seq").cast(kind)).withColumns(own)
        done = sorted((r.topic or "", str(r.seq), r.confidence) for r in maintain.resolve_contradictions(df).collect())
        assert done == [("", "1", 1.0), ("t", "1", 0.5), ("t", "2", 1.0), ("t", "3", 1.0), ("t", "None", 1.0)]


def test_consolidation_without_merge_reads_texts_twice(spark):
    """Once to find what is contradicted, once for what is left."""
    assert scans_of_texts(QUERIES["consolidate_without_merge"](spark, SF)) == 2


def large_topic(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("aeilrsu", k=6)) for _ in range(3000)]
    rows = [("t", i, i, " ".join(rng.choices(vocabulary, k=200)) + (" never" if i % 2 else "")) for i in range(5000)]
    own = {"confidence": F.lit(1.0), "staleness": F.lit(0.0), "entropy": F.lit(1.0), "ts": now(), "source_refs": F.array(F.lit("a")), "embedding": F.array(*(F.when(F.col("seq") % 8 == i, 1.0).otherwise(0.0) for i in range(8)))}
    return spark.createDataFrame(rows, "topic string, vec_id long, seq long, text string").withColumns(own)


def test_consolidation_report_of_a_large_topic_in_time(spark):
    began, df = time.monotonic(), large_topic(spark)
    assert maintain.consolidation_report(df, maintain.consolidate(df)).collect()[0].asDict() == {"topic": "t", "before": 5000, "after": 8, "removed": 4992, "merged": 4992, "absolute": 0}
    assert time.monotonic() - began < 30


def test_consolidation_without_merge_of_a_large_topic_in_time(spark):
    began, df = time.monotonic(), large_topic(spark)
    assert maintain.consolidate(df, threshold=1.0).count() == 300
    assert time.monotonic() - began < 30


def test_contradiction_pairs_of_a_large_topic_in_time(spark):
    began, df = time.monotonic(), large_topic(spark)
    assert maintain.contradiction_pairs(df).where("(older + newer) % 2 = 1").count() == maintain.contradiction_pairs(df).count() > 6_000_000
    assert time.monotonic() - began < 30


def test_resolving_contradictions_of_a_large_topic_in_time(spark):
    began, df = time.monotonic(), large_topic(spark)
    assert maintain.resolve_contradictions(df).where("confidence = 0.5").count() > 4900
    assert time.monotonic() - began < 30


def test_ivf_recall(spark):
    recall = [r.recall for r in QUERIES["ivf_recall"](spark, "/root/testdata/sf0.01").collect()]
    assert len(recall) == 25 and sum(recall) / len(recall) >= 0.9


def test_batch_topk_in_parts(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 9 = 0")

    def rows():
        return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in search.batch_topk(q, v, 3).collect())

    whole = rows()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 800)
    assert rows() == whole
    assert search.batch_topk(q.limit(0), v, 3).count() == 0 and search.batch_topk(q, v.limit(0), 3).count() == 0


def plain_recent(rows, window, distance):
    out, kept = [], defaultdict(lambda: deque(maxlen=window))
    for key, order, value in sorted(rows):
        if all(bin((value ^ x) & (1 << 64) - 1).count("1") > distance for x in kept[key]):
            kept[key].append(value)
            out.append((key, order, value))
    return out


def test_recent_duplicates_against_plain(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(30)]
    rows = [(f"k{i % 3}", i, rng.choice(base) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    for window, distance in ((5, 6), (300, 6), (300, 0)):
        assert sorted(map(tuple, S.drop_recent_duplicates(df, "k", "o", "v", window, distance).collect())) == plain_recent(rows, window, distance)
    assert df.select(S.hamming(F.lit(5), F.lit(6)).alias("d")).first().d == 2


def test_scene_changes_against_plain(spark):
    rng = random.Random(2)
    rows = [(f"k{i % 2}", i, float(rng.randrange(100))) for i in range(200)]
    expected = []
    for key in ("k0", "k1"):
        last = None
        for n, (k, o, v) in enumerate(r for r in rows if r[0] == key):
            if n % 3 == 0 and (last is None or abs(v - last) > 25):
                expected.append((k, o, v))
                last = v
    got = S.scene_changes(spark.createDataFrame(rows, "k string, o long, v double").repartition(5), "k", "o", "v", 25, 3).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_adding_in_batches_or_at_once(spark):
    items = [("t", i, t, 0.9, 0) for i, t in enumerate(["the bridge is 30 meters long", "the bridge is 60 meters long", "the bridge is never closed for the old boats", "the bridge is closed for the old boats", "short", "password = hunter2 and more"])]
    schema = "topic string, seq long, text string, confidence double, ttl_days long"
    df = spark.createDataFrame(items, schema)
    empty = ingest.add_memories(_first(spark), df.limit(0), now()).drop("added", "quality")
    once = ingest.add_memories(empty, df, now())
    half = ingest.add_memories(empty, df.where("seq < 2"), now()).drop("added", "quality")
    twice = ingest.add_memories(half, df.where("seq >= 2"), now())
    columns = ["topic", "chunk_id", "text", "confidence", "staleness"]
    assert sorted(map(tuple, once.select(columns).collect())) == sorted(map(tuple, twice.select(columns).collect()))
    rows = {r.seq: r for r in once.collect()}
    assert set(rows) == {0, 1, 2, 3} and rows[0].chunk_id == "c0001" and rows[0].confidence < 0.8 and rows[2].confidence < 0.9
    assert {r.reason for r in ingest.split_excluded(df).collect()} == {None, "too_short", "secret"}
    assert ingest.topic_rows(once).first().chunks == 4


def _first(spark):
    return spark.createDataFrame([], "topic string, seq long, chunk_id string, text string, text_hash string, confidence double, staleness double, entropy double, ts timestamp, ttl_ts timestamp, embedding_q struct<bits:int,scale:double,qmax:int,dim:int,values:array<int>>")


def test_cache_and_fusions(spark):
    cache, asked = pipeline.ResultCache(2), []

    def rows(n):
        asked.append(n)
        return spark.range(n)

    for n in (1, 2, 1, 3, 2):
        assert len(cache.rows(pipeline.ResultCache.key("q", n=n), lambda n=n: rows(n))) == n
    assert asked == [1, 2, 3, 2] and cache.statistics()["hit_rate"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        pipeline.fuse("colbert")
    with pytest.raises(ValueError):
        pipeline.multistage(spark.range(1), [1.0], 1, stages=["rerank"])
    assert "Range" in pipeline.query_plan(spark.range(3))


def test_like_takes_wildcards_as_they_are(spark):
    df = spark.createDataFrame([("100% sure",), ("100 sure",), ("a_b",), ("aXb",), ("back\\slash",)], "t string")
    for needle, expected in (("100%", ["100% sure"]), ("A_B", ["a_b"]), ("\\", ["back\\slash"])):
        assert [r.t for r in df.where(pipeline.like(F.col("t"), needle)).collect()] == expected


def test_store_roundtrips(spark, tmp_path):
    rows = [("a", "c0001", "first text", 0.5), ("b", "c0001", "second text", 0.7)]
    df = spark.createDataFrame(rows, "topic string, chunk_id string, text string, confidence double")
    store.write_chunks(df, f"{tmp_path}/store")
    store.write_chunks(df.where("topic = 'a'").withColumn("text", F.lit("new")), f"{tmp_path}/store")
    back = {r.topic: r for r in store.read_chunks(spark, f"{tmp_path}/store").collect()}
    assert back["a"].text == "new" and back["b"].text == "second text" and back["b"].quality == 0.5
    assert store.read_chunks(spark, f"{tmp_path}/store", ["b"]).count() == 1
    assert store.backup(df, f"{tmp_path}/backup") == {"chunks": 2, "topics": 2}
    assert store.restore(spark, f"{tmp_path}/backup", f"{tmp_path}/store").where("text = 'first text'").count() == 1
    assert store.checksum(spark, f"{tmp_path}/backup/chunks").first()[0] == store.checksum(spark, f"{tmp_path}/backup/chunks").first()[0]
    turns = spark.createDataFrame([("user", "hello"), ("robot", "beep")], "role string, text string").withColumn("ts", now())
    store.add_turns(turns, f"{tmp_path}/turns")
    assert [r.text for r in store.read_turns(spark, f"{tmp_path}/turns").collect()] == ["hello"]
    (tmp_path / "note.txt").write_text("line one\nline two")
    assert store.read_documents(spark, f"{tmp_path}/note.txt").first().text == "line one\nline two"
    quality = maintain.quality_of(df.withColumns({"staleness": F.lit(0.1), "verified": F.lit(True), "quality": F.lit(0.5)}), "a", "c0001").first()
    assert quality.overall > 0 and maintain.quality_of(df.withColumns({"staleness": F.lit(0.1), "verified": F.lit(True), "quality": F.lit(0.5)}), "a", "c9").first().overall == 0


def test_zone_maps_and_migrations(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("vec_id"), F.timestamp_seconds("id").alias("ts"))
    logs.write_segments(df, f"{tmp_path}/s", 4)
    zones = sorted((r.least, r.most) for r in logs.zone_maps(spark, f"{tmp_path}/s").collect())
    assert len(zones) == 4 and all(a[1] < b[0] for a, b in zip(zones, zones[1:], strict=False))
    assert logs.migrate(df, 1).columns == ["vec_id", "ts", "quality", "verified", "entropy", "importance", "source"]
    assert logs.last_version(df, "vec_id").first().version == 99 and logs.last_version(df.limit(0), "vec_id").first().version == 0
    with pytest.raises(ValueError):
        logs.report({})
    assert metrics.index_statistics(spark.createDataFrame([("a", 0.5), (None, 0.7)], "topic string, confidence double")).first().without_topic == 1


def test_watch_folder_and_replay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a\nb")
    found = []
    E.replay(S.watch_folder(spark, f"{tmp_path}/in"), lambda df, n: found.extend(r.text for r in df.collect()), f"{tmp_path}/checkpoint")
    (tmp_path / "in" / "b.txt").write_text("c")
    E.replay(S.watch_folder(spark, f"{tmp_path}/in"), lambda df, n: found.extend(r.text for r in df.collect()), f"{tmp_path}/checkpoint")
    assert found == ["a\nb", "c"]


class Loud(plugins.Plugin):
    pass


def test_plugins(spark, tmp_path):
    r = plugins.Registry()
    loud = Loud()
    r.add("scorer", "loud", loud, volume=3)
    assert loud.settings == {"volume": 3} and r.names("scorer") == ["loud"]
    r.remove("scorer", "loud")
    assert loud.settings == {} and r.names("scorer") == []
    assert r.load("embedder", "hashed", "engram.functions.vectors", "embed_hashed") is V.embed_hashed and r.embedder() is V.embed_hashed
    r.set_embedder(lambda t: F.array(F.length(t).cast("double")))
    assert spark.range(1).select(r.embedder()(F.lit("abc")).alias("e")).first().e == [3.0]
    with pytest.raises(ValueError):
        r.add("nothing", "x", loud)
    kept = plugins.ParquetStore(spark, f"{tmp_path}/plugin", "vec_id")
    kept.save(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    assert kept.search([1.0, 0.1], 1).first().vec_id == 1 and kept.without(spark.range(2).withColumnRenamed("id", "vec_id")).count() == 1
    assert r.load_installed() == []


def test_packing_of_unequal_rows(spark):
    values = [[1, 2, 3], [], [15] * 9, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<int>").coalesce(1)
    back = {r.i: r.b for r in df.withColumn("p", V.pack(4)("v")).select("i", V.unpack(4)("p", F.size("v")).alias("b")).collect()}
    assert back == dict(enumerate(values))


def test_moving_centroid_is_the_fold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([("t", i, v.tolist()) for i, v in enumerate(x)], "topic string, i long, embedding array<double>")
    c = x[0]
    for v in x[1:]:
        c = 0.95 * c + 0.05 * v
    assert np.allclose([r.value for r in S.moving_centroids(df, "i").orderBy("pos").collect()], c)


def test_index_settings_and_times(spark):
    assert [search.index_settings(n, 384)["nlist"] for n in (1, 10_000, 100_000, 1_000_000)] == [256, 1024, 4096, 8192]
    row = spark.range(1).select(X.clock(F.lit(-3)).alias("a"), X.clock(F.lit(3723.9)).alias("b"), X.safe_name(F.lit("a.b/c\\d")).alias("c"), maintain.e_folding(F.lit(90 * 86400.0)).alias("d")).first()
    assert (row.a, row.b, row.c) == ("0:00:00", "1:02:03", "a_b_c_d") and row.d == pytest.approx(np.exp(-1))
