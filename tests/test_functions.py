from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import filters, maintain
from engram.sources import store


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(V.BITS), st.data())
def test_packing_is_reversible(bits, data):
    values = data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=40))
    packed = V.pack_values(np.array(values, np.uint32), bits) if values else b""
    assert list(V.unpack_values(packed, bits, len(values))) == values
    assert len(packed) == -(-len(values) * bits // 8)


def test_codec_fidelity(spark):
    x = np.random.default_rng(42).normal(size=(50, 384))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "e array<double>")
    for bits, least in ((4, 0.98), (6, 0.999), (8, 0.9999)):
        assert df.select(V.cosine(F.col("e"), V.dequantize(V.quantize(F.col("e"), bits))).alias("c")).agg(F.min("c")).first()[0] > least
    with pytest.raises(ValueError):
        V.quantize(F.col("e"), 5)


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(V.cosine(F.col("a"), F.col("b")), 6)).collect()] == [0.0, -1.0]


def test_exclusion(spark):
    cases = {"short": "too_short", "x" * 5001: "too_long", "my password: hunter22": "secret", "debug: something happened": "debug", "git commit all the things": "blocked_pattern", "a plain sentence of words": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(X.exclusion_reason(F.col("t"), F.lit(""))).collect()] == list(cases.values())


def test_absolute(spark):
    df = spark.createDataFrame([("maybe it works\n\n\nperhaps ",), ("",)], "t string")
    assert [r[0] for r in df.select(X.make_absolute(F.col("t"))).collect()] == ["It works", ""]


def test_chunks_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(X.chunks(F.col("t"))).alias("c")).select("c.*").collect()
    assert [(r.pos, r.chunk) for r in found] == [(i, text[i * 1000 : i * 1000 + 1200]) for i in range(3)]


def test_contradictions(spark):
    rows = [("t", 1, "the limit is 25 units"), ("t", 2, "the limit is 30 units"), ("t", 3, "the limit is 30 units"), ("u", 1, "the server never restarts after upgrades"), ("u", 2, "server restarts after upgrades")]
    df = spark.createDataFrame(rows, "topic string, seq int, text string").withColumns({"confidence": F.lit(1.0), "staleness": F.lit(0.0)})
    found = {(r.topic, r.seq): round(r.confidence, 2) for r in maintain.contradiction_decay(df).collect()}
    assert found == {("t", 1): 0.36, ("t", 2): 1.0, ("t", 3): 1.0, ("u", 1): 0.6, ("u", 2): 1.0}


def test_filter_parser(spark):
    df = spark.createDataFrame([("a", 0.5, -1), ("b", 0.9, 2), (None, None, None)], "topic string, confidence double, n int")
    assert filters.parse("topic != a, confidence >= 0.5").apply(df).count() == 1
    assert filters.parse("n in (-1;2)").apply(df).count() == 2
    assert filters.parse("n not in (2)").apply(df).count() == 2
    with pytest.raises(ValueError):
        filters.parse("nonsense")


def test_store_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("t1", "c0001", "text one"), ("t2", "c0001", "text two")], "topic string, chunk_id string, text string")
    store.write_chunks(df, str(tmp_path / "s"))
    back = store.read_chunks(spark, str(tmp_path / "s"), ["t2"])
    assert [(r.topic, r.text, r.confidence, r.verified) for r in back.collect()] == [("t2", "text two", 0.5, False)]
    assert store.backup(df, str(tmp_path / "b")) == {"chunks": 2, "topics": 2}
    assert store.restore(spark, str(tmp_path / "b")).count() == 2


def test_conflicts(spark):
    a = spark.createDataFrame([(1, 5, "l"), (2, 5, "l")], "k int, ts int, w string")
    b = spark.createDataFrame([(1, 5, "r"), (2, 6, "r"), (3, 1, "r")], "k int, ts int, w string")
    won = {r.k: r.w for r in maintain.resolve_conflicts(a, b, "k", "ts").collect()}
    assert won == {1: "l", 2: "r", 3: "r"}
    assert {r.k: r.w for r in maintain.resolve_conflicts(a, b, "k", "ts", "source_wins").collect()}[1] == "r"
