"""Benchmark decontamination by an FM-index of each training shard (operator 1).

A shard is a batch of documents' words as symbols: the benchmark's distinct words, and one symbol
for all runs of others, which no window can span.  Its suffix array gives the Burrows-Wheeler
transform, held in a wavelet matrix; all benchmark windows are searched backwards at once, their
occurrences located by walking to sampled suffix positions, and covered words merged into spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import words as W
from engram.llm.common import bound_batches, table, utf8, with_results
from engram.session import ship_package

WINDOW = 10
#: Bytes of text in a shard, and of benchmark texts that are searched in one pass.
SHARD_BYTES, BENCHMARK_BYTES = 1 << 22, 1 << 22
#: Every suffix position that this divides is kept.
SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of an integer sequence in order, by prefix doubling.

    A suffix that ends sorts before its extensions.
    """
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if n == 0 or new[order[-1]] == n:
            return order
        rank, k = new, 2 * k


class WaveletMatrix:
    """rank and access over a sequence of small integers, for arrays of questions."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs before place i."""
        begin, end = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            up = ((c >> level) & 1).astype(bool)
            b, e = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            begin = np.where(up, zeros + b, begin - b)
            end = np.where(up, zeros + e, end - e)
        return end - begin

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it occurs before."""
        begin, end, c = np.zeros(len(i), np.int64), i.astype(np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            b, e = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            up = ones[end + 1] - ones[end] == 1
            c = 2 * c + up
            begin = np.where(up, zeros + b, begin - b)
            end = np.where(up, zeros + e, end - e)
        return c, end - begin


class FMIndex:
    """Counting and locating of patterns in a sequence of symbols 1 to symbols - 1."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        s = np.concatenate([s, [0]])  # the end, which is smaller than all symbols
        sa = suffix_array(s)
        self.wavelet = WaveletMatrix(s[sa - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = sa[self.sampled]
        self.n = len(s)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of rows whose suffixes begin with the patterns.

        Patterns are rows of an array, filled from the right; all are extended to the left by one
        symbol at a time, those already out of the shard no longer.
        """
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((lengths > step) & (high > low))
            if not len(on):
                break
            c = patterns[on, patterns.shape[1] - 1 - step]
            low[on], high[on] = self.before[c] + self.wavelet.rank(c, low[on]), self.before[c] + self.wavelet.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin, by steps to the left up to a sampled position."""
        out, row, steps, on = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(on):
            here = self.sampled[row[on]]
            done = on[here]
            out[done] = self.samples[self.sample_rank[row[done]]] + steps[done]
            on = on[~here]
            c, rank = self.wavelet.access_rank(row[on])
            row[on] = self.before[c] + rank
            steps[on] += 1
        return out


@dataclass
class Windows:
    """The distinct windows of a part of the benchmark."""

    vocabulary: np.ndarray  # sorted hashes of its words; the symbol of the i-th is i + 2
    patterns: np.ndarray  # (windows, WINDOW) symbols, filled from the right
    lengths: np.ndarray
    owners: np.ndarray  # the windows' items, one window after the other
    bounds: np.ndarray  # items of window i are owners[bounds[i] : bounds[i + 1]]
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], size: int = WINDOW) -> Windows:
        """Null items have windows, but no name."""
        names = sorted({str(item) for item, _ in rows if item is not None})
        number = {name: i for i, name in enumerate(names)}
        hashes = [W.words((text or "").encode(), W.ALNUM)[0] for _, text in rows]
        vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        parts, of = [np.empty((0, size), np.int32)], [np.empty(0, np.int64)]
        for (item, _), h in zip(rows, hashes, strict=True):
            if len(h):
                symbols = np.zeros(max(len(h), size), np.int32)
                symbols[-len(h) :] = np.searchsorted(vocabulary, h) + 2
                parts.append(sliding_window_view(symbols, size))
                of.append(np.full(len(parts[-1]), -1 if item is None else number[str(item)]))
        patterns, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(of)], axis=1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1))
        return cls(vocabulary, patterns, (patterns > 0).sum(axis=1), pairs[:, 1], bounds, names)

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.bounds[window] : self.bounds[window + 1]]]


def shard_hits(texts: list[bytes], windows: Windows) -> list[tuple[int, list[int], set[str], np.ndarray, np.ndarray]]:
    """For each text: number of words, merged spans of hit words (flat), items, word starts and ends."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first, last, h, bounds, starts, ends in W.batches(texts, W.ALNUM):
        parts += [(h[a:b], starts[a:b], ends[a:b]) for a, b in zip(bounds[: last - first], bounds[1:], strict=True)]
    counts = np.array([len(h) for h, _, _ in parts], np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    spans: list[list[int]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if len(windows.lengths) and begin[-1]:
        h = np.concatenate([p[0] for p in parts])
        at = np.minimum(np.searchsorted(windows.vocabulary, h), len(windows.vocabulary) - 1)
        symbol = np.where(windows.vocabulary[at] == h, at + 2, 1)
        # positions of the shard's sequence: words, each text's end, runs of other words as one symbol
        place = np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts)
        sequence, owner = np.ones(len(h) + len(texts), np.int64), np.full(len(h) + len(texts), -1, np.int64)
        sequence[place], owner[place] = symbol, np.arange(len(h))
        keep = np.concatenate([[True], (sequence[1:] != 1) | (sequence[:-1] != 1)])
        # stretches of benchmark words that are shorter than every window hold none
        edge = np.flatnonzero(np.diff(np.concatenate([[0], sequence != 1, [0]]))).reshape(-1, 2)
        edge = edge[edge[:, 1] - edge[:, 0] < windows.lengths.min()]
        drop = np.zeros(len(sequence) + 2, np.int8)
        drop[edge[:, 0]] += 1
        drop[edge[:, 1] + 1] -= 1
        keep &= np.cumsum(drop, dtype=np.int8)[: len(sequence)] == 0
        sequence, owner = sequence[keep], owner[keep]
        if len(sequence):
            index = FMIndex(sequence, len(windows.vocabulary) + 2)
            low, high = index.search(windows.patterns, windows.lengths)
            n = high - low
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
            word = owner[index.locate(rows)]
            document = np.searchsorted(begin, word, "right") - 1
            for pair in np.unique(document * len(n) + which).tolist():
                items[pair // len(n)].update(windows.items(pair % len(n)))
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, word, 1)
            np.add.at(cover, word + windows.lengths[which], -1)
            hit = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)
            for d in set(document.tolist()):
                own = np.concatenate([[0], hit[begin[d] + 1 : begin[d + 1] + 1], [0]])
                spans[d] = np.flatnonzero(np.diff(own)).tolist()
    return [(int(c), s, i, p[1], p[2]) for c, s, i, p in zip(counts, spans, items, parts, strict=True)]


def merge_spans(spans: list[int], more: list[int]) -> list[int]:
    """The union of two flat lists of half-open spans, in order; spans that touch become one."""
    out: list[int] = []
    for a, b in sorted([*zip(spans[::2], spans[1::2], strict=True), *zip(more[::2], more[1::2], strict=True)]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, into: str | None = None) -> DataFrame:
    """docs with n_words, hit_spans, hit_items and clean_bytes; columns of these names are replaced, or all go into a struct.

    hit_spans is a flat array of half-open word spans in order, merged; hit_items has the ids (as
    strings, sorted) of the items with a window in the text; clean_bytes is the size of the text
    with the spans removed.  A null or empty text has no words and no hits, and neither has an item
    without words; an item with a null id marks hits but is not listed; repeated items count once,
    repeated documents each for themselves.  A benchmark of more than BENCHMARK_BYTES comes in
    parts, one after the other, each held by a broadcast of its own.
    """
    benchmark = benchmark.select("item_id", "text")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // BENCHMARK_BYTES))
    windows = []
    for i in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else benchmark
        windows.append(benchmark.sparkSession.sparkContext.broadcast(Windows.of([(r[0], r[1]) for r in part.distinct().collect()], window)))

    def run(column: pa.Array) -> list[list]:
        texts = utf8(column)
        n_words, spans, items, clean = [0] * len(texts), [[] for _ in texts], [set() for _ in texts], [len(t) for t in texts]
        for part in windows:
            for i, (n, own, its, starts, ends) in enumerate(shard_hits(texts, part.value)):
                n_words[i] = n
                if own:
                    spans[i] = merge_spans(spans[i], own)
                    items[i] |= its
                    clean[i] = len(texts[i]) - sum(int(ends[b - 1] - starts[a]) for a, b in zip(spans[i][::2], spans[i][1::2], strict=True))
        return [n_words, spans, [sorted(x) for x in items], clean]

    schema = pa.schema([("n_words", pa.int64()), ("hit_spans", pa.list_(pa.int64())), ("hit_items", pa.list_(pa.string())), ("clean_bytes", pa.int64())])
    return with_results(docs, run, docs["text"], schema, SHARD_BYTES, into)


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    _, starts, ends = W.words(data, W.ALNUM)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]]).decode()


def remove_contamination(found: DataFrame) -> DataFrame:
    """The result of find_contamination with its hit spans cut out of text; null texts stay null."""
    ship_package(found.sparkSession)
    bound_batches(found.sparkSession)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut_spans(t, s) if t and s else t for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return found.withColumn("text", cut("text", "hit_spans"))


def op1_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    # end - (start - (end - ...)): the spans' lengths, added up
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, x: x - total)
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)
