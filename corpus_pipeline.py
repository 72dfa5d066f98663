"""A training corpus from raw documents: language, near duplicates, benchmark, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in
the shared folder and reads again for the next one.  All stages but the last return the columns
of documents, other columns of any name included.  An empty table passes through all of them.
Nulls, ties, repeated rows and very long texts are handled as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import free_name, materialise, table
from engram.llm.decontamination import find_contamination
from engram.llm.langid import UNDETERMINED, identify, train
from engram.llm.mixing import mixed_documents
from engram.llm.ngram_join import one_of_each
from engram.llm.sharding import assign_shards

#: SQL can't express the first stage's learned model; the tests hold run() against a plain version.
ORACLE_SQL = None

SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be determined go; a null lang becomes the predicted one.

    That are those with a null or empty text or without a letter, and all of them where no row has
    a lang to learn from.  Whole texts are read; repeated rows get equal answers and all stay.
    """
    into = free_name(docs, "_language")
    found = identify(docs, train(docs), into=into).where(F.col(into)["lang_pred"] != UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", F.col(into)["lang_pred"])).drop(into)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays (word 5-grams, Jaccard 0.8 or more).

    It is the one of the least doc_id, null ids last; among equal ids the least hash of the text,
    and of equal rows one.  A document of fewer than five words links with equal ones only, and one
    without words, or with a null text, with none: it stays.
    """
    return one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null text holds none; an item without words has none; an item of fewer than ten words is one
    window.  An empty benchmark lets all documents pass.
    """
    into = free_name(docs, "_contamination")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), into=into)
    return found.where(F.size(F.col(into)["hit_spans"]) == 0).drop(into)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    Null is a source of its own; a document without words, or with a null text, stays once; rows
    that agree in doc_id, source and text are taken equally often.  Reruns agree.
    """
    return mixed_documents(docs)


def assign_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, and the one that one more shard would give them.

    doc_id alone decides, so copies and repeated rows share a shard, and null ids are one key;
    columns named shard and grown_shard are replaced.
    """
    return assign_shards(docs, [1.0] * SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("shards", assign_to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
