"""Vector arithmetic and codecs as column expressions; bit packing as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
BITS = (4, 6, 8)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def as_double(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _parts(a: Column, b: Column) -> Column:
    return F.struct(dot(a, b).alias("ab"), norm(a).alias("a"), norm(b).alias("b"))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is shorter than EPS; vectors are normalised by their length plus EPS."""
    return let(_parts(a, b), lambda p: F.when((p["a"] < EPS) | (p["b"] < EPS), F.lit(0.0)).otherwise(p["ab"] / ((p["a"] + EPS) * (p["b"] + EPS))))


def cosine_plain(a: Column, b: Column) -> Column:
    """Without an epsilon; 0 for a zero vector."""
    return let(_parts(a, b), lambda p: F.coalesce(F.try_divide(p["ab"], p["a"] * p["b"]), F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b) + 1e-8)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(a: Column) -> Column:
    return let(norm(a) + EPS, lambda n: F.transform(a, lambda x: x / n))


def _check(bits: int) -> int:
    if bits not in BITS:
        raise ValueError(f"bits must be one of {BITS}")
    return (1 << (bits - 1)) - 1


def quantize(v: Column, bits: int = 6) -> Column:
    """struct(bits, scale, qmax, dim, values): symmetric, half-to-even, values from 0 to 2 * qmax."""
    qmax = _check(bits)
    scale = (F.array_max(F.transform(v, lambda x: F.abs(x))) + EPS) / qmax

    def struct(s: Column) -> Column:
        values = F.transform(v, lambda x: (F.greatest(F.lit(-float(qmax)), F.least(F.lit(float(qmax)), F.rint(x / s))) + qmax).cast("int"))
        return F.struct(F.lit(bits).alias("bits"), s.alias("scale"), F.lit(qmax).alias("qmax"), F.size(v).alias("dim"), values.alias("values"))

    return let(scale, struct)


def dequantize(q: Column) -> Column:
    return let(q, lambda r: F.transform(r["values"], lambda u: (u - r["qmax"]) * r["scale"]))


def quantize_fixed(v: Column, bits: int = 6) -> Column:
    """Values of the range -1 to 1 (clipped) as 0 to 2**bits - 1."""
    top = float((1 << bits) - 1)
    return F.transform(v, lambda x: F.rint((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) / 2 * top).cast("int"))


def dequantize_fixed(values: Column, bits: int = 6) -> Column:
    return F.transform(values, lambda u: u / F.lit(float((1 << bits) - 1)) * 2 - 1)


def quantize_affine4(v: Column) -> Column:
    """struct(scale, zero, dim, values from 0 to 15); a flat vector has scale 1 and values 0."""

    def struct(r: Column) -> Column:
        scale = F.when(r["high"] == r["low"], F.lit(1.0)).otherwise((r["high"] - r["low"]) / 15)
        return let(scale, lambda s: F.struct(s.alias("scale"), r["low"].alias("zero"), F.size(v).alias("dim"), F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(15.0), F.rint((x - r["low"]) / s))).cast("int")).alias("values")))

    return let(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), struct)


def dequantize_affine4(q: Column) -> Column:
    return let(q, lambda r: F.transform(r["values"], lambda u: u * r["scale"] + r["zero"]))


def compression_ratio(bits: Column) -> Column:
    return F.lit(32.0) / bits


def pack_values(values: np.ndarray, bits: int) -> bytes:
    """Unsigned values as a stream of bits, least significant first."""
    planes = (np.asarray(values, np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_values(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n values; what the data is too short for is 0."""
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits]
    planes = np.concatenate([planes, np.zeros(n * bits - len(planes), np.uint8)]).reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1)


def _pack_batch(values: pa.Array, bits: int) -> pa.Array:
    """Bit streams of a batch of lists; each row starts at a byte."""
    lengths = pa.compute.list_value_length(values).fill_null(0).to_numpy()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
    if len(flat) and (lengths == lengths[0]).all():  # one shape: all rows at once
        planes = ((flat.reshape(len(lengths), -1, 1) >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(lengths), -1)
        packed = np.packbits(planes, axis=1, bitorder="little")
        offsets = np.arange(len(lengths) + 1, dtype=np.int32) * packed.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
    ends = np.cumsum(lengths)
    rows = [pack_values(flat[e - n : e], bits) for e, n in zip(ends, lengths, strict=True)]
    return pa.array([r if ok else None for r, ok in zip(rows, values.is_valid().to_pylist(), strict=True)], pa.binary())


def pack(bits: int):
    """An Arrow-batched function from array<int> to binary."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return _pack_batch(values, bits)

    return run


def unpack(bits: int):
    """An Arrow-batched function from (binary, dim) to array<int>."""

    @F.arrow_udf("array<int>")
    def run(data: pa.Array, dim: pa.Array) -> pa.Array:
        return pa.array([None if d is None else unpack_values(d, bits, int(n)).astype(np.int32) for d, n in zip(data.to_pylist(), dim.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return run


def dot_packed(query: Column, data: Column, scale: Column, dim: Column, bits: int = 6) -> Column:
    """Inner product of a vector and packed bytes, which are decoded for it."""
    qmax = (1 << (bits - 1)) - 1
    return dot(query, F.transform(unpack(bits)(data, dim), lambda u: (u - qmax) * scale))


def cosine_packed(query: Column, data: Column, scale: Column, dim: Column, bits: int = 6) -> Column:
    qmax = (1 << (bits - 1)) - 1
    return let(F.transform(unpack(bits)(data, dim), lambda u: (u - qmax) * scale), lambda v: cosine(query, v))


def embed_hashed(text: Column, dim: int = 64) -> Column:
    """A deterministic bag-of-words vector of length 1: tokens are counted by their hash."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    slots = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int") % dim)
    counts = let(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
    return let(counts, l2_normalize)
