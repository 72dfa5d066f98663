"""The pipeline against a plain version of its stages, and its guards."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F
from test_operators import SCHEMA, plain_components, plain_mix, plain_shard, rows

import corpus_pipeline
from engram.llm import decontamination, langid, mixing


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([r[:5] for r in rows()], ", ".join(SCHEMA.split(", ")[:5]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "naïve café übermäßig señor")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r in rows() if any(c.isalpha() for c in r[1] or "")]
    sets, roots = plain_components([r[1] for r in kept], 5, 80)
    best: dict[int, tuple] = {}
    for r, root in zip(kept, roots, strict=True):
        key = (r[0] is None, r[0] or 0)
        if root not in best or key < best[root][0]:
            best[root] = (key, r)
    expected = sorted((r[0] for _, r in best.values() if "café" not in r[1]), key=repr)
    stages = [f for _, f in corpus_pipeline.STAGES[:3]]
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for f in stages:
        frame = f(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
    assert sorted((r.doc_id for r in frame.collect()), key=repr) == expected
    # the mix and the shards by their plain versions
    kept, size = Counter(), {}
    for (doc_id, source, h), taken in plain_mix(frame).items():
        size[doc_id, source, h] = None
        kept[doc_id, source, h] = sum(taken) / len(taken)
    lengths = {(r.doc_id, r.source, r.h): r.n for r in frame.select("doc_id", "source", F.xxhash64("text").alias("h"), mixing.n_words(F.col("text")).alias("n")).collect()}
    times = Counter({k: 1 if not lengths[k] else math.floor(kept[k] / lengths[k] + 0.5) for k in size})
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) < set(out.columns)
    got = Counter((r.doc_id, r.source, r.h) for r in out.select("doc_id", "source", F.xxhash64("text").alias("h")).collect())
    assert got == +times
    hashes = out.select("doc_id", "shard", "grown_shard", F.array(*[F.xxhash64("doc_id", F.lit(k), F.lit(42)) for k in range(17)]).alias("h")).collect()
    assert all((r.shard, r.grown_shard) == (plain_shard(r.h, 16), plain_shard(r.h, 17)) for r in hashes)


def test_other_columns_pass(spark, tmp_path):
    spark.createDataFrame([(1, "naïve café übermäßig señor")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([r[:5] for r in rows()], ", ".join(SCHEMA.split(", ")[:5])).withColumns({c: F.lit(c) for c in ("a.b", "shard.x", "_text", "score")})
    for _, f in corpus_pipeline.STAGES[:4]:
        after = f(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.where("`a.b` <> 'a.b' OR score <> 'score' OR _text <> '_text'").isEmpty()
    assert corpus_pipeline.assign_to_shards(spark, docs, str(tmp_path)).columns == [*docs.columns, "shard", "grown_shard"]


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], ", ".join(SCHEMA.split(", ")[:5]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify(docs, langid.train(docs))
    assert found.where((F.col("lang_pred") == "und") & F.col("text").rlike(r"\p{L}")).count() == 0
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontamination.find_contamination(docs, benchmark.limit(0)).where(F.size("hit_spans") > 0).count() == 0
