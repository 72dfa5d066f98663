"""Word hashing over batches of whole texts, vectorised in numpy.

A batch of UTF-8 texts is joined into one byte buffer and scanned once; each word gets the
64-bit value of a polynomial over its bytes, from prefix sums, and a final bit mix.  Memory is
bounded by ``CHUNK`` bytes of text at a time (a single word longer than that extends its chunk).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _class(separators: set[int]) -> np.ndarray:
    return np.array([b not in separators for b in range(256)])


#: Words are runs of anything but ASCII white space.
NON_SPACE = _class({0x20, *range(0x09, 0x0E)})
#: Words are runs of 0-9, a-z and everything outside ASCII (texts are lower-cased first).
ALNUM = _class({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """P**i and P**-i modulo 2**64, grown when a chunk needs more of them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 4096)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)])) for p in (_P, _P_INV))
        return self.up, self.down


_POWERS = _Powers()


def scan(buffer: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (byte offsets) of the words of one buffer."""
    a = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = is_word[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.get(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends


def words(text: bytes, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and byte spans of all words of one whole text, in pieces of about CHUNK bytes."""
    if lower:
        text = text.translate(LOWER)
    if len(text) <= CHUNK:
        return scan(text, is_word)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and is_word[text[end - 1]]:  # never inside a word
            end += 1
        h, s, e = scan(text[at:end], is_word)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def batches(texts: list[bytes], is_word: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first, last, hashes, bounds, starts, ends) for consecutive groups of texts.

    Words of text ``first + i`` are ``hashes[bounds[i]:bounds[i + 1]]``; starts and ends are
    byte offsets within their own text.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            h, s, e = words(texts[i], is_word, lower)
            yield i, j, h, np.array([0, len(h)]), s, e
        else:
            joined = b"\n".join(texts[i:j])
            h, s, e = scan(joined.translate(LOWER) if lower else joined, is_word)
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[i:j]])])
            bounds = np.searchsorted(s, begin)
            shift = np.repeat(begin[:-1], np.diff(bounds))
            yield i, j, h, bounds, s - shift, e - shift
        i = j


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in their order; len(hashes) must be n at least."""
    with np.errstate(over="ignore"):
        x = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            x = mix(x * np.uint64(_P) + hashes[i : len(hashes) - n + 1 + i])
    return x


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; fewer words make one shingle, none make none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(grams(hashes, min(n, len(hashes))))
