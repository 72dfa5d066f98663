"""Hierarchical language identification (operator 8).

A text's features are its hashed letter 1-, 2- and 3-grams.  A linear support vector machine
predicts the language family first; then one-versus-one linear machines separate the languages
of that family.  The machines are trained on a bounded sample of labelled rows (``ROWS`` in all,
``ROWS_A_LANGUAGE`` of each language at most); every whole text is predicted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import map_arrow, table, with_results

ROWS, ROWS_A_LANGUAGE = 12_000, 500
BUCKETS = 1 << 13
#: Characters of a text that are looked at together.
PIECE = 1 << 17
BATCH_BYTES = 1 << 21
UNDETERMINED = "und"

#: Language families by ISO 639-1 code; a language outside is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), lang)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed letter 1- to 3-grams of a whole text, or None if it has no letter.

    Anything but a letter counts as one space between words.
    """
    counts, found, is_letter = np.zeros(BUCKETS, np.int64), False, _letters()
    for at in range(0, len(text), PIECE):
        # surrogates can't be encoded; they are no letters anyway
        points = np.frombuffer(text[max(0, at - 2) : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = is_letter[points]
        if not letter.any():
            continue
        found = True
        c = np.where(letter, points, 0).astype(np.uint64)
        c = np.concatenate([[np.uint64(0)], c, [np.uint64(0)]])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        shift = np.uint64(64 - 13)
        for n in (1, 2, 3):
            h = c[: len(c) - n + 1] + np.uint64(n)
            for i in range(1, n):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) + c[i : len(c) - n + 1 + i]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            counts += np.bincount((h >> shift).astype(np.int64), minlength=BUCKETS)
    return counts if found else None


def features(counts: np.ndarray) -> np.ndarray:
    """Roots of relative frequencies: a vector of length 1."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def train_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of an L2-loss linear machine for labels -1 and 1 of some rows of x, by dual coordinate descent."""
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    damping = 1 / (2 * cost * balance)
    norms = np.einsum("ij,ij->i", x, x)[rows] + 1 + damping
    w, bias, alpha, random = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(y)):
            own = x[rows[i]]
            gradient = y[i] * (float(w @ own) + bias) - 1 + damping[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * own
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, np.float32(bias))


@dataclass
class OneVersusOne:
    """One machine for each pair of classes; a class's score is its mean probability against the others."""

    classes: list[str]
    weights: np.ndarray  # (pairs, BUCKETS + 1); positive for the pair's first class

    @classmethod
    def train(cls, x: np.ndarray, rows: np.ndarray, labels: Sequence[str]) -> OneVersusOne:
        """``labels`` are those of the ``rows`` of x."""
        classes, of = sorted(set(labels)), np.array(labels)
        weights = []
        for a, b in combinations(classes, 2):
            mine = (of == a) | (of == b)
            weights.append(train_svm(x, rows[mine], np.where(of[mine] == a, 1.0, -1.0)))
        return cls(classes, np.array(weights, np.float32).reshape(-1, BUCKETS + 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(n, classes) scores from 0 to 1."""
        if len(self.classes) == 1:
            return np.ones((len(x), 1))
        first = 1 / (1 + np.exp(-4 * (x @ self.weights[:, :-1].T + self.weights[:, -1]).astype(np.float64)))
        out = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            out[:, a] += first[:, k]
            out[:, b] += 1 - first[:, k]
        return out / (len(self.classes) - 1)


@dataclass
class LanguageModel:
    families: OneVersusOne | None
    members: dict[str, OneVersusOne]

    @classmethod
    def train(cls, x: np.ndarray, langs: Sequence[str]) -> LanguageModel:
        if not len(langs):
            return cls(None, {})
        names = np.array([family(lang) for lang in langs])
        members = {f: OneVersusOne.train(x, np.flatnonzero(names == f), [lang for lang, n in zip(langs, names, strict=True) if n == f]) for f in sorted(set(names))}
        return cls(OneVersusOne.train(x, np.arange(len(x)), list(names)), members)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores; without labels to learn from, all are undetermined."""
        if self.families is None or not len(x):
            return [UNDETERMINED] * len(x), np.zeros(len(x))
        by_family = self.families.scores(x)
        chosen = by_family.argmax(axis=1)
        langs, score = np.empty(len(x), object), np.zeros(len(x))
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(chosen == k)
            if len(rows):
                within = self.members[name].scores(x[rows])
                best = within.argmax(axis=1)
                langs[rows] = np.array(self.members[name].classes, object)[best]
                score[rows] = by_family[rows, k] * within[np.arange(len(rows)), best]
        return list(langs), score


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame) -> DataFrame:
    """(lang, text): a bounded sample of the labelled rows that are not held out.

    Ids are chosen from the narrow columns by a hash, first those under a threshold that leaves
    about twice what is needed of each language; then the chosen ids' texts are fetched.
    """
    labelled = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"])).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled.select("lang", "text").limit(0)
    each = max(1, min(ROWS_A_LANGUAGE, ROWS // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limits = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * each / n + 1e-4)))])
    ids = labelled.select("doc_id", "lang", draw.alias("draw")).where(F.col("draw") <= limits[F.col("lang")])
    ids = ids.groupBy("lang", "draw", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    # at most ROWS rows of three numbers: a proven bound
    ids = F.broadcast(ids.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).select("doc_id", "lang"))
    return labelled.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame) -> LanguageModel:
    """Fits the machines; only hashed counts of the sample come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, data = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (counts := gram_counts(text)) is not None:
                    at = np.flatnonzero(counts)
                    langs.append(lang)
                    data.append(at.astype("<u2").tobytes() + np.minimum(counts[at], 2**32 - 1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], names=["lang", "counts"])

    rows = sorted((r["lang"], bytes(r["counts"])) for r in map_arrow(_sample(docs), run, "lang string, counts binary").collect())
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, data) in enumerate(rows):
        n = len(data) // 6
        counts = np.zeros(BUCKETS, np.int64)
        counts[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<u4", n, 2 * n)
        x[i] = features(counts)
    return LanguageModel.train(x, [lang for lang, _ in rows])


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text", into: str | None = None) -> DataFrame:
    """docs with lang_pred and score (0 to 1); columns of these names are replaced, or both go into a struct.

    A null text, or one without letters, is ``und`` with score 0.  Equal texts get equal answers;
    every row is kept; an empty table gives an empty table.
    """

    def run(column: pa.Array) -> list[list]:
        texts = column.to_pylist()
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts), 256):
            counts = [(i, c) for i, t in enumerate(texts[at : at + 256], at) if t and (c := gram_counts(t)) is not None]
            if counts:
                found, score = model.predict(np.array([features(c) for _, c in counts]))
                for (i, _), lang, s in zip(counts, found, score, strict=True):
                    langs[i], scores[i] = lang, float(min(1.0, max(0.0, s)))
        return [langs, scores]

    return with_results(docs, run, docs[text_column], pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]), BATCH_BYTES, into)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
