"""Token counts of whole texts (operator 4).

Texts go to the tokenizer in Arrow batches and only lengths come back.  Batches are balanced by
bytes, not by rows.  Every text, long ones above all, is split at safe boundaries, where the
pre-tokenizer cuts anyway, so that the pieces' counts add up to the count of the whole text.
Natural text repeats its pieces, so a batch encodes each distinct piece once, and a worker
remembers the lengths of recent ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from engram.llm.common import map_arrow, pieces, table

#: Bytes of text for one batch.
BATCH_BYTES = 1 << 21
#: Lengths that a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000

#: White space beside the space, the line feed, the tab and the carriage return.
_RARE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")

_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def safe_pieces(text: str) -> list[str]:
    """The text cut at single spaces between two characters that are not white space.

    There the byte-level pattern ends one piece of its own and begins the next (" word"), and no
    special token can span the place.  The spaces are left out: each but the first piece stands
    for itself after a space.  A space at either end of the text is such a place, too.
    """
    unsafe = "  " in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or _RARE.search(text)
    return _SAFE.split(text) if unsafe else text.split(" ")


class Lengths(dict):
    """Token counts of pieces after a space, each encoded once while it is remembered."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.missed.append(piece)
        return 0

    def _encode(self, pieces_: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces_, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        if len(self) > REMEMBERED:
            self.clear()
        split = [safe_pieces(t) for t in texts]
        counts, late = self._encode([p[0] for p in split]), []
        for i, p in enumerate(split):
            counts[i] += sum(map(self.__getitem__, p[1:]))
            late.append(self.missed)
            self.missed = []
        new = list({x for p in late for x in p})
        self.update(zip(new, self._encode([" " + x for x in new]), strict=True))
        return [n + sum(map(self.__getitem__, p)) for n, p in zip(counts, late, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    ``path`` names the tokenizer's file, which every executor must be able to open.  A null text
    counts as empty: 0 bytes, 0 tokens.  Rows with equal or null ids each keep their own row;
    other columns are ignored, whatever their names.  An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(_tokenizer(path))
        for batch in pieces(batches, "text", BATCH_BYTES):
            n_bytes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            counts = lengths.count([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_column], docs[text_column].alias("text"))
    return map_arrow(rows, run, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
