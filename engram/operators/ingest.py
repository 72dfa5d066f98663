"""Writing memories: exclusion, vectors, contradictions, ids, quality and centroids for a batch at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import maintain, search

Embed = Callable[[Column], Column]


def expiry(as_of: Column, ttl_days: Column, default_days: float | None = None) -> Column:
    """When a memory expires; no days, or none at all, mean the default, and without one never."""
    days = F.coalesce(F.nullif(ttl_days.cast("double"), F.lit(0.0)), F.lit(default_days).cast("double"))
    return F.timestamp_micros(F.unix_micros(as_of) + (days * 86_400_000_000).cast("long"))


def split_excluded(items: DataFrame) -> DataFrame:
    """items with ``reason``: why a text isn't stored, ``failed`` for a null one, or null."""
    return items.withColumn("reason", F.when(F.col("text").isNull(), "failed").otherwise(X.exclusion_reason(F.col("text"), F.col("topic"))))


def add_memories(store: DataFrame, items: DataFrame, as_of: Column, embed: Embed = V.embed_hashed, bits: int = 6, ttl_days: float | None = None) -> DataFrame:
    """The store with the items that no rule excludes, as new chunks.

    ``store`` has topic, seq, text, confidence, staleness and the columns made here; ``items`` has
    topic, seq, text, confidence and ttl_days, seq being the order in which they come, after all
    of the store.  One plan does what adding one by one would: a new chunk lowers the confidence
    of all earlier ones of its topic that it contradicts, and ids go on from the topic's largest.
    """
    new = split_excluded(items).where(F.col("reason").isNull())
    last = store.groupBy("topic").agg(F.max(F.substring("chunk_id", 2, 18).cast("long")).alias("_last"))
    number = F.row_number().over(Window.partitionBy("topic").orderBy("seq"))
    new = new.withColumn("_n", number).join(last, "topic", "left").withColumn("chunk_id", F.format_string("c%04d", F.coalesce("_last", F.lit(0)) + F.col("_n")))
    text = F.col("text")
    made = new.select(
        "topic", "seq", "chunk_id", "text", F.sha1(text).alias("text_hash"), "confidence", F.lit(0.0).alias("staleness"), X.entropy(text).alias("entropy"), as_of.alias("ts"), expiry(as_of, F.col("ttl_days"), ttl_days).alias("ttl_ts"), V.quantize(embed(text), bits).alias("embedding_q"), F.lit(True).alias("added")
    )
    kept = store.select(*made.columns[:-1], F.lit(False).alias("added"))
    both = maintain.contradiction_decay(kept.unionByName(made), newer=F.col("added"))
    return both.withColumn("quality", X.quality(F.col("text"), F.col("confidence"), F.col("staleness"), F.lit(False), F.lit(0.0))["overall"])


def memory_rows(items: DataFrame, tags: Column, agent: Column, importance: Column, name: Column) -> DataFrame:
    """items with tags, agent_id, importance and memory_id, a short hash of what names them."""
    return items.withColumns({"tags": tags, "agent_id": agent, "importance": importance, "memory_id": F.substring(F.sha1(name), 1, 16)})


def topic_rows(chunks: DataFrame) -> DataFrame:
    """(topic, chunks, centroid_q): the table of topics, made anew from their chunks.

    A centroid is the mean of the dequantized vectors, quantized to 8 bits.
    """
    plain = chunks.select("topic", V.dequantize(F.col("embedding_q")).alias("embedding"))
    centroids = search.centroid_vectors(plain).select("topic", V.quantize(F.col("centroid"), 8).alias("centroid_q"))
    return chunks.groupBy("topic").agg(F.count(F.lit(1)).alias("chunks")).join(centroids, "topic")


def etl(docs: DataFrame, topics: DataFrame | None = None, embed: Embed = V.embed_hashed, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunks of documents (doc_id, text), each with an id, its document's kind, entities, a packed vector and a topic.

    Texts of a document that repeat are kept once.  ``topics`` has (topic, centroid); without it
    all chunks are of topic 0.
    """
    pieces = docs.select("doc_id", X.schema_of_chunks(F.col("text")).alias("kind"), F.explode(X.chunks(F.col("text"), size, overlap)).alias("c"))
    rows = pieces.select("doc_id", "kind", F.col("c.pos").alias("pos"), F.col("c.chunk").alias("text"))
    rows = maintain.first_of_each(rows.withColumn("_sha1", F.sha1("text")), ["doc_id", "_sha1"], [F.col("pos")]).drop("_sha1")
    text = F.col("text")
    chunk_id = F.substring(F.sha1(F.concat(F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.substring(text, 1, 200))), 1, 16)
    rows = rows.select("doc_id", "pos", chunk_id.alias("chunk_id"), "kind", "text", X.entities(text).alias("entities"), F.when(F.length(text) > 30, 0.85).otherwise(0.55).alias("confidence"), embed(text).alias("embedding"))
    rows = rows.withColumn("assigned", F.lit("0")) if topics is None else search.assign_topic(rows, topics)
    return rows.withColumnRenamed("assigned", "topic").withColumn("packed", V.quantize_affine4(F.col("embedding"))).drop("embedding")
