"""Mixing sources to target weights with a low-discrepancy schedule (operator 2) [native].

Every source is a shuffled stream of its documents' words, cut into blocks of equal numbers of
words, the number being each source's own.  The mix is a sequence of slots.  Slot i has the
golden-ratio point frac(i * phi); mapped through the cumulative numbers of blocks that meet the
targets it names a source, and the k-th slot of a source takes the source's k-th block, starting
anew after the last one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import DOCUMENT_COLUMNS, free_name, materialise, quoted, running_totals, table

#: The fractional part of the golden ratio.
PHI = (math.sqrt(5) - 1) / 2
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix's words for a word of the corpus; no source gives more than EPOCHS times its words.
SHARE, EPOCHS = 1.5, 2
#: Blocks that meet the targets, at least, where a block has more than a word: this many dealt
#: evenly to the sources, or this many for each source if that is more.
SLOTS, SLOTS_A_SOURCE = 1 << 17, 1 << 10
#: Cells of equal width that points and the sources' shares of them are dealt out by.
CELLS = 1 << 12
#: Slots whose ranks one task finds.
SLOT_RANGE = 1 << 14


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, sid, target) for (source, source_size), one row a source.

    Sources in the order of their code points, null last, weigh ``weights``, repeating.  Targets
    are the weighted shares of ``share`` times all words, but at most ``epochs`` times a source's
    words; the excess goes to the others by weight until none is above.  Sorted by limit over
    weight, a source is held to its limit just if the rest, shared among it and those after it,
    would give it more.  The windows see one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sid = F.row_number().over(order) - 1
    sizes = sizes.withColumn("sid", sid).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1))
    sizes = sizes.withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_all": F.sum("source_size").over(everything) * F.lit(share), "_weights": F.sum("_w").over(everything)})
    sizes = sizes.withColumns({"_taken": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_gone": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    sizes = sizes.withColumn("_level", (F.col("_all") - F.col("_taken")) / (F.col("_weights") - F.col("_gone")))
    held = F.col("_cap") <= F.col("_level") * F.col("_w")
    # the level of the first source that is not held is everyone's after it
    level = F.min(F.when(~held, F.struct(F.col("_cap") / F.col("_w"), "sid", "_level"))).over(everything)["_level"]
    target = F.when(held | level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return sizes.select("source", "source_size", "sid", target.alias("target"))


def schedule(targets: DataFrame, block_words: Column, blocks: Column) -> DataFrame:
    """(sid, block, uses): how often the mix takes each block of each source.

    ``targets`` has sid and source_size; ``block_words`` and ``blocks`` are columns of it, the words
    of a block of the source and the number of blocks that meet its target.
    """
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = targets.withColumns({"_upto": F.sum(blocks).over(upto), "_own": blocks, "_slots": F.sum(blocks).over(Window.partitionBy()), "_words": block_words})
    bounds = bounds.where(F.col("_own") > 0)
    # a source owns the points from _from to _to; it is found by the cells that these reach into
    bounds = bounds.withColumns({"_from": (F.col("_upto") - F.col("_own")) / F.col("_slots"), "_to": F.col("_upto") / F.col("_slots")})
    cells = F.sequence(F.floor(F.col("_from") * CELLS).cast("long"), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS)).cast("long"))
    owners = bounds.select("sid", "source_size", "_words", "_from", "_to", F.explode(cells).alias("_cell"))
    whole = bounds.agg(F.max("_slots").alias("_slots")).where(F.col("_slots") > 0)
    ranges = whole.select("_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / SLOT_RANGE).cast("long"))).alias("_range")).repartition("_range")
    begin = F.col("_range") * SLOT_RANGE
    slot_rows = ranges.select("_range", F.explode(F.sequence(begin, F.least(begin + (SLOT_RANGE - 1), F.col("_slots") - 1))).alias("slot"))
    slot_rows = slot_rows.withColumn("_point", (F.col("slot") * F.lit(PHI)) % 1.0).withColumn("_cell", F.floor(F.col("_point") * CELLS).cast("long"))
    picked = slot_rows.join(owners, "_cell").where((F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to"))).select("_range", "slot", "sid", "source_size", "_words")
    # ranks: the source's slots in earlier ranges, and those before it in its own
    keys = ["sid", "_range"]
    sums = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("sid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("slot")) - 1
    ranked = picked.withColumn("_own", own).join(sums, keys).withColumn("rank", F.col("_base") + F.col("_own"))
    blocks = F.ceil(F.col("source_size") / F.col("_words")).cast("long")
    ranked = ranked.where((F.col("source_size") > 0) & (F.col("rank") < EPOCHS * blocks))
    return ranked.select("sid", (F.col("rank") % blocks).alias("block")).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs; see mix_rows."""
    return mix_rows(docs, weights, seed).drop("source", "_text")


def mix_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 42) -> DataFrame:
    """What mix_documents returns, with source and the hash of the text.

    A null text has no words; a document without words takes nothing.  Null is a source of its
    own.  Repeated rows are documents of their own.  The shuffle depends on the seed and the rows'
    values alone, so reruns agree; an empty table gives an empty table.  Other columns are
    ignored.
    """
    # 1. one narrow row for each distinct document, with its number of copies
    narrow = docs.select("doc_id", "source", n_words(docs["text"]).alias("size"), F.xxhash64(docs["text"]).alias("_text"))
    narrow = narrow.groupBy("doc_id", "source", "size", "_text").agg(F.count(F.lit(1)).alias("copies"))
    narrow = materialise(narrow, "mix-sizes")
    # 2. the sources' targets: a row for each source
    targets = source_targets(narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights)
    least = F.greatest(F.lit(SLOTS_A_SOURCE), F.floor(F.lit(SLOTS) / F.count(F.lit(1)).over(Window.partitionBy())))
    targets = targets.withColumn("_words", F.greatest(F.lit(1), F.floor(F.col("target") / least)).cast("long"))
    targets = materialise(targets.withColumn("_blocks", F.ceil(F.col("target") / F.col("_words")).cast("long")), "mix-targets")
    uses = schedule(targets, F.col("_words"), F.col("_blocks"))
    # 3. where each document lies in its source's shuffled stream
    placed = narrow.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "_text"))
    placed = running_totals(placed, ["sid"], ["_hash", "doc_id", "_text", "size"], F.col("size") * F.col("copies"), "_at")
    placed = materialise(placed.select("sid", "doc_id", "source", "_text", "size", "copies", "source_size", "target", "_words", "_at", F.xxhash64("sid", "_at", "doc_id", "_text", "size").alias("_row")), "mix-placed")
    # 4. its words block by block, each as often as the schedule takes the block
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_copy")
    rows = placed.select("*", one).withColumn("_at", F.col("_at") + F.col("_copy") * F.col("size"))
    held = rows.where(F.col("size") > 0)
    block = F.explode(F.sequence(F.floor(F.col("_at") / F.col("_words")), F.floor((F.col("_at") + F.col("size") - 1) / F.col("_words")))).alias("block")
    held = held.select("sid", "_row", "_copy", "_at", "size", "_words", block)
    words = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * F.col("_words")) - F.greatest(F.col("_at"), F.col("block") * F.col("_words"))
    taken = held.withColumn("_n", words).join(uses, ["sid", "block"]).groupBy("_row", "_copy").agg(F.sum(F.col("_n") * F.col("uses")).alias("taken"))
    out = rows.join(taken, ["_row", "_copy"], "left")
    return out.select("doc_id", "source", "_text", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 42) -> DataFrame:
    """The mix itself: every document as often as the nearest whole number of times it is taken.

    Half counts up; a document without words stays once, as it takes no room.  Rows that agree in
    doc_id, source and text are taken equally often.  Returns the columns of docs.
    """
    keys = ("doc_id", "source", "_text")
    plan = mix_rows(docs, weights, seed).groupBy(*keys).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    own, n, time = [free_name(docs, f"_mix_{k}") for k in keys], free_name(docs, "_mix_times"), free_name(docs, "_mix_time")
    plan = materialise(plan.select(*(F.col(k).alias(name) for k, name in zip(keys, own, strict=True)), times.alias(n)), "mix-plan")
    mine = (docs["doc_id"], docs["source"], F.xxhash64(docs["text"]))
    same = [c.eqNullSafe(plan[name]) for c, name in zip(mine, own, strict=True)]
    out = docs.join(plan.where(plan[n] > 0), same[0] & same[1] & same[2])
    return out.withColumn(time, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*[docs[quoted(c)] for c in docs.columns])


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS))
