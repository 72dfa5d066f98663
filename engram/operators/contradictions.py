"""Contradicting pairs of large topics: blocks of chunks held against each other by matrices of shared words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.session import ship_package

#: What a block compares: texts with numbers, texts with and without a negation, texts with dates.
NUMBERS, NEGATION, DATED = 0, 1, 2
#: Long words that two texts must share for a negation, and for dates, to count.
SHARED, SHARED_DATED = 3, 2
#: Pairs of chunks that are counted at a time, and rows of a result.
CELLS, OUT = 1 << 20, 1 << 16
#: Rows of small blocks that are held together, and chunks of the other side with which a search begins.
TOGETHER, FIRST = 1024, 64
#: A word of more than this share of a block's pairs is a column of a matrix; the pairs of others are listed.
DENSE = 1 / 256


def links(chunks: DataFrame, size: int, negations: list[str], whole: bool, newer: Column | None = None) -> DataFrame:
    """Contradicting pairs (topic, older, newer).

    Chunks have topic, an integer seq, text and ``parts``.  A topic is dealt into so many parts, and a
    block holds one part against another.  With ``whole`` numbers and dates count too, as in
    ``text.contradicts``; else the differing negation only, as in ``text.contradicts_short``.
    """
    ship_package(chunks.sparkSession)
    seq = chunks.schema["seq"].dataType
    found = X.contradiction_columns(F.col("text"))
    rows = chunks.select("topic", F.col("seq").cast("long").alias("seq"), "parts", (F.lit(True) if newer is None else newer).alias("new"), X.negated(F.col("text"), negations).alias("neg"), *(found[c].alias(c) for c in (("words", "numbers", "dates") if whole else ("words",))))
    if not whole:
        rows = rows.withColumns({"numbers": F.lit(None).cast("array<double>"), "dates": F.lit(None).cast("array<string>")})
    rows = rows.where(F.col("neg").isNotNull()).withColumns({"low": F.array_min("numbers"), "high": F.array_max("numbers"), "n": F.size("words"), "words": F.array_join("words", " "), "dates": F.when(F.size("dates") > 0, F.array_join("dates", " "))})
    own, others = F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)

    def places(kind: int, right: Column) -> Column:
        """A chunk's blocks on one side: those of its part, with any part on the other side."""
        return F.transform(others, lambda p: F.struct(F.lit(kind).alias("kind"), F.when(right, p).otherwise(own).alias("i"), F.when(right, own).otherwise(p).alias("j"), right.alias("right")))

    none = F.array().cast("array<struct<kind:int,i:int,j:int,right:boolean>>")
    at = [F.when(F.col("n") >= SHARED, places(NEGATION, ~F.col("neg"))).otherwise(none)]
    if whole:
        for kind, which in ((NUMBERS, F.col("low").isNotNull()), (DATED, F.col("dates").isNotNull() & (F.col("n") >= SHARED_DATED))):
            at += [F.when(which, places(kind, F.lit(right))).otherwise(none) for right in (False, True)]
    rows = rows.withColumn("at", F.explode(F.concat(*at)))
    words = F.when(F.col("at.kind") != NUMBERS, F.col("words"))
    rows = rows.select("topic", "at.kind", "at.i", "at.j", "at.right", "seq", "new", "neg", "low", "high", "dates", words.alias("words"))
    block = ["topic", "kind", "i", "j"]
    tasks = max(int(size), 4 * chunks.sparkSession.sparkContext.defaultParallelism)
    schema = f"topic {chunks.schema['topic'].dataType.simpleString()}, older long, newer long"
    out = rows.repartition(tasks, *block).sortWithinPartitions(*block, "right").mapInArrow(_compare, schema)
    return out.withColumns({c: F.col(c).cast(seq) for c in out.columns[1:]})


def older(chunks: DataFrame, size: int, negations: list[str]) -> DataFrame:
    """(topic, older): chunks that a newer one contradicts by ``text.contradicts_short``, perhaps repeated.

    As in ``links`` a block holds a part of a topic's negated texts against a part of its others, but a
    chunk that is found leaves the search, which begins with the newest chunks of the other side.
    """
    ship_package(chunks.sparkSession)
    seq, topic = chunks.schema["seq"].dataType, chunks.schema["topic"].dataType.simpleString()
    rows = chunks.where(F.col("topic").isNotNull() & F.col("seq").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("topic", F.col("seq").cast("long").alias("seq"), "parts", X.negated(F.col("text"), negations).alias("neg"), F.lower("text").alias("words"))
    rows = rows.mapInArrow(_long_words, f"topic {topic}, seq long, parts int, neg boolean, words string")
    own, others = F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    at = F.transform(others, lambda p: F.struct(F.when(F.col("neg"), own).otherwise(p).alias("i"), F.when(F.col("neg"), p).otherwise(own).alias("j")))
    block = ["topic", "kind", "i", "j"]
    rows = rows.withColumn("at", F.explode(at)).select("topic", F.lit(NEGATION).alias("kind"), "at.i", "at.j", "seq", "neg", "words")
    tasks = max(int(size), 4 * chunks.sparkSession.sparkContext.defaultParallelism)
    out = rows.repartition(tasks, *block).sortWithinPartitions(*block).mapInArrow(_contradicted, f"topic {topic}, older long")
    return out.withColumn("older", F.col("older").cast(seq))


def _long_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-case texts as their distinct long words, joined; without those of too few to contradict any."""
    for batch in batches:
        lists = pc.ascii_split_whitespace(batch.column("words"))
        tokens, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = tokens.dictionary_encode()
        codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        long = pc.greater(pc.utf8_length(vocabulary), 3).to_numpy(zero_copy_only=False)[codes]
        width = max(1, len(vocabulary))
        found = np.sort(row[long] * width + codes[long])  # numpy's unique is many times slower
        row, codes = np.divmod(found[np.diff(found, prepend=-1) > 0], width)
        n = np.bincount(row, minlength=len(lists))
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), vocabulary.take(pa.array(codes))), " ")
        yield batch.set_column(batch.schema.get_field_index("words"), "words", words).filter(pa.array(n >= SHARED))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The kind and the rows of each block, which follow each other."""
    last, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and keys[at] != last:
                yield last[1], pa.Table.from_batches(held)
                held = []
            last = keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield last[1], pa.Table.from_batches(held)


def _coded(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows as numbers, and their rows."""
    lists = pc.split_pattern(words, " ")
    codes = pc.list_flatten(lists).combine_chunks().dictionary_encode().indices.to_numpy()
    return codes, np.repeat(np.arange(len(words), dtype=np.int32), pc.list_value_length(lists).to_numpy())


def _shared(left: pa.ChunkedArray, right: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(first right row, counts of shared words of right rows and all left ones), some right rows at a time."""
    return _counts(*_coded(pa.chunked_array([*left.chunks, *right.chunks], left.type)), len(left), len(right))


def _counts(codes: np.ndarray, row: np.ndarray, n: int, m: int) -> Iterator[tuple[int, np.ndarray]]:
    """``_shared`` of n left and m right rows, whose words follow each other."""
    border = int(np.searchsorted(row, n))
    vocabulary = int(codes.max(initial=-1)) + 1
    in_left, in_right = np.bincount(codes[:border], minlength=vocabulary), np.bincount(codes[border:], minlength=vocabulary)
    common = in_left.astype(np.float64) * in_right
    is_dense = common > n * m * DENSE
    column = np.cumsum(is_dense) - 1
    columns = int(is_dense.sum())

    def matrix(codes: np.ndarray, rows: np.ndarray, height: int) -> np.ndarray:
        out = np.zeros((height, columns), np.float32)
        at = is_dense[codes]
        out[rows[at], column[codes[at]]] = 1
        return out

    dense = matrix(codes[:border], row[:border], n).T
    listed = (common > 0) & ~is_dense
    at = np.flatnonzero(listed[codes[:border]])
    at = at[np.argsort(codes[at], kind="stable")]
    posting = row[at]
    length = np.where(listed, in_left, 0)
    start = np.cumsum(length) - length
    step = max(1, CELLS // max(1, n))
    for first in range(0, m, step):
        height = min(step, m - first)
        a, b = np.searchsorted(row, [n + first, n + first + height])
        own, rows = codes[a:b], row[a:b] - n - first
        counts = (matrix(own, rows, height) @ dense).astype(np.int32) if columns else np.zeros((height, n), np.int32)
        rare = listed[own]
        own, rows = own[rare], rows[rare]
        ends = np.cumsum(length[own])
        at = 0
        while at < len(own):  # so many words that their pairs fit
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
            lengths = length[own[at:end]]
            offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            cell = np.repeat(rows[at:end].astype(np.int64) * n, lengths) + posting[np.repeat(start[own[at:end]], lengths) + offset]
            counts += np.bincount(cell, minlength=height * n).reshape(height, n).astype(np.int32)
            at = end
        yield first, counts


def _far(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return ~(np.abs(low - high) / (np.maximum(np.abs(low), np.abs(high)) + X.EPSILON) <= 0.1)


class _Side:
    def __init__(self, rows: pa.Table) -> None:
        def plain(name: str, empty: object) -> np.ndarray:
            return rows.column(name).combine_chunks().fill_null(empty).to_numpy(zero_copy_only=False)

        self.words, self.seq, self.new, self.neg = rows.column("words"), plain("seq", 0), plain("new", False), plain("neg", False)
        self.low, self.high, self.numbered = plain("low", 0.0), plain("high", 0.0), pc.is_valid(rows.column("low")).combine_chunks().to_numpy(zero_copy_only=False)
        self.dates = rows.column("dates")


def _pairs(kind: int, left: _Side, right: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and right that contradict by this kind and by none before it."""

    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return left.numbered[a] & right.numbered[b] & (_far(left.low[a], right.high[b]) | _far(left.high[a], right.low[b]))

    if kind == NUMBERS:
        step = max(1, CELLS // max(1, len(left.seq)))
        for first in range(0, len(right.seq), step):
            some = np.arange(first, min(first + step, len(right.seq)))
            earlier = left.seq[None, :] < right.seq[some, None]
            b, a = np.nonzero(earlier & far(np.arange(len(left.seq))[None, :], some[:, None]))
            yield a, b + first
        return
    if kind == DATED:
        dates = pa.chunked_array([*left.dates.chunks, *right.dates.chunks], left.dates.type).combine_chunks().dictionary_encode().indices.to_numpy()
        mine, other = dates[: len(left.seq)], dates[len(left.seq) :]
    for first, counts in _shared(left.words, right.words):
        b, a = np.nonzero(counts >= (SHARED if kind == NEGATION else SHARED_DATED))
        shared, b = counts[b, a], b + first
        fits = ~far(a, b)
        if kind == NEGATION:
            fits &= left.seq[a] != right.seq[b]
        else:
            fits &= (left.seq[a] < right.seq[b]) & (mine[a] != other[b]) & ~((left.neg[a] != right.neg[b]) & (shared >= SHARED))
        yield a[fits], b[fits]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, rows in _blocks(batches):
        left, right = (_Side(rows.filter(m)) for m in (pc.invert(rows.column("right")), rows.column("right")))
        if not len(left.seq) or not len(right.seq):
            continue
        topic = rows.column("topic")[0]
        for a, b in _pairs(kind, left, right):
            x, y = left.seq[a], right.seq[b]
            new = np.where(x < y, right.new[b], left.new[a])
            found = [np.minimum(x, y)[new], np.maximum(x, y)[new]]
            for at in range(0, len(found[0]), OUT):
                some = [pa.array(v[at : at + OUT], pa.int64()) for v in found]
                yield pa.RecordBatch.from_arrays([pa.repeat(topic, len(some[0])), *some], names=["topic", "older", "newer"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows of one large block or of several small ones, with the numbers of their blocks."""
    held: list[pa.Table] = []
    n = 0
    for _, rows in _blocks(batches):
        if held and n + rows.num_rows > TOGETHER:
            yield np.repeat(np.arange(len(held)), [t.num_rows for t in held]), pa.concat_tables(held)
            held, n = [], 0
        held.append(rows)
        n += rows.num_rows
    if held:
        yield np.repeat(np.arange(len(held)), [t.num_rows for t in held]), pa.concat_tables(held)


def _some(codes: np.ndarray, start: np.ndarray, length: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some rows, in their order, and the places of their rows in it."""
    n = length[rows]
    at = np.arange(n.sum()) + np.repeat(start[rows] - (np.cumsum(n) - n), n)
    return codes[at], np.repeat(np.arange(len(rows), dtype=np.int32), n)


def _contradicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(topic, older) of each block's chunks that a newer one of the other side contradicts."""
    for block, rows in _gathered(batches):
        neg, seq = (rows.column(c).to_numpy() for c in ("neg", "seq"))
        if neg.all() or not neg.any():
            continue
        codes, row = _coded(rows.column("words"))
        if block[-1]:  # a word of another block is another word
            codes = np.unique(block[row] * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        length = np.bincount(row, minlength=len(seq))
        start = np.cumsum(length) - length
        newest = np.argsort(seq)[::-1]
        number, hit = np.full(int(codes.max()) + 1, -1), np.zeros(len(seq), bool)
        for side in (True, False):
            left, right = np.flatnonzero(neg == side), newest[neg[newest] != side]
            at, step = 0, FIRST
            while at < len(right):
                left = left[~hit[left] & (seq[left] < seq[right[at]])]
                if not len(left):
                    break
                some = right[at : at + step]
                (a, i), (b, j) = (_some(codes, start, length, which) for which in (left, some))
                vocabulary, b = np.unique(b, return_inverse=True)
                number[vocabulary] = np.arange(len(vocabulary))
                a = number[a]
                number[vocabulary] = -1
                a, i = a[a >= 0], i[a >= 0]
                for first, counts in _counts(np.concatenate([a, b]), np.concatenate([i, j + len(left)]), len(left), len(some)):
                    later = seq[some[first : first + len(counts)], None] > seq[left][None, :]
                    hit[left[((counts >= SHARED) & later).any(axis=0)]] = True
                at, step = at + step, 4 * step
        found = rows.filter(pa.array(hit))
        for batch in found.select(["topic", "seq"]).rename_columns(["topic", "older"]).to_batches():
            yield batch
