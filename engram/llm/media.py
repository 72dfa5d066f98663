"""Media columns (operator 6): Netpbm and BMP images, NPY tiles, difference hashes.

Images come as binary columns.  They are decoded to numpy arrays, resized by exact area means
from integral images, written as NPY tiles, and fingerprinted by a difference hash.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from engram.llm.common import map_arrow, pieces, table, utf8

#: Rows of an image whose integral is held at once.
STRIP = 1 << 12
#: The payload of a text is a whole number of rows of this many samples; 576 = 64 * 9.
ROW = 64
UNIT = 576
BATCH_BYTES = 1 << 21


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greyscale Netpbm file (P5) of an (h, w) array of bytes."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    values, at = [], 2
    for _ in range(fields):
        m = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d+)").match(data, at)
        if not m:
            raise ValueError("Netpbm header ends early")
        values.append(int(m[1]))
        at = m.end()
    return values, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3) arrays of uint8, or of uint16 if maxval is over 255.

    Samples are as they are stored; tiles set them against the file's maxval.
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    bitmap = kind in (b"P1", b"P4")
    (w, h, *rest), at = _netpbm_header(data, 2 if bitmap else 3)
    top = rest[0] if rest else 1
    if not 0 < top < 65536 or not w or not h:
        raise ValueError("bad Netpbm header")
    channels = 3 if kind in (b"P3", b"P6") else 1
    shape = (h, w, 3) if channels == 3 else (h, w)
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"\s|#[^\r\n]*", b"", data[at:]), np.uint8)[: w * h]
        return np.where(bits.reshape(shape) == ord("1"), 0, 255).astype(np.uint8)
    if kind == b"P4":
        stride = (w + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride)
        return np.where(np.unpackbits(rows, axis=1)[:, :w] == 1, 0, 255).astype(np.uint8)
    if kind in (b"P2", b"P3"):
        plain = re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[: w * h * channels]
        return np.array(plain, dtype=np.int64).astype(np.uint8 if top < 256 else np.uint16).reshape(shape)
    sample = np.dtype(np.uint8 if top < 256 else ">u2")
    return np.frombuffer(data, sample, w * h * channels, at + 1).reshape(shape).astype(sample.newbyteorder("="), copy=False)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits a pixel, as (h, w, 3) arrays in RGB order.

    Pixels of 16 and 32 bits may have masks that say where each colour's bits are.
    """
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    (offset,) = struct.unpack_from("<I", data, 10)
    header, w, h, _, bits, compression = struct.unpack_from("<IiiHHI", data, 14)
    masked = compression in (3, 6) and bits in (16, 32)
    if not (compression == 0 or masked) or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h:
        raise ValueError("this kind of BMP is not read")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)
    if h > 0:  # stored from the bottom up
        rows = rows[::-1]
    if bits in (16, 32):
        masks = struct.unpack_from("<III", data, 54) if masked else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        pixels = np.ascontiguousarray(rows[:, : w * bits // 8]).view(f"<u{bits // 8}").astype(np.uint64)
        return np.stack([_masked(pixels, m) for m in masks], axis=2)
    if bits == 24:
        return rows[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1].copy()
    (colours,) = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + header).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = rows[:, :w]
    else:
        index = np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits) @ (1 << np.arange(bits)[::-1])
        index = index[:, :w]
    return palette[index]


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as values from 0 to 255."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    value = (pixels & np.uint64(mask)) >> np.uint64(low)
    return np.rint(value.astype(np.float64) * 255 / top).astype(np.uint8)


def maxval(data: bytes) -> int:
    """The sample value of full brightness."""
    return _netpbm_header(data, 3)[0][2] if data[:2] in (b"P2", b"P3", b"P5", b"P6") else 255


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _integral_at(image: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """The integral image of an (h, w) array at fractional places: sums left of x and above y.

    Within a pixel the integral is bilinear, so interpolation is exact.  Only a strip's column
    sums are held, and the rows that are asked for.
    """
    h, w = image.shape
    out = np.zeros((len(ys), len(xs)))
    whole_x = np.minimum(xs.astype(np.int64), w - 1)
    part_x = xs - whole_x
    top = np.zeros(w)
    whole_y = np.minimum(ys.astype(np.int64), h - 1)
    for begin in range(0, h, STRIP):
        strip = image[begin : begin + STRIP]
        mine = np.flatnonzero((whole_y >= begin) & (whole_y < begin + len(strip)))
        if len(mine):
            rows = np.zeros((len(strip) + 1, w))
            np.cumsum(strip, axis=0, out=rows[1:], dtype=np.float64)
            rows += top
            upper, lower = rows[whole_y[mine] - begin], rows[whole_y[mine] - begin + 1]
            columns = upper + (lower - upper) * (ys[mine] - whole_y[mine])[:, None]
            table_ = np.concatenate([np.zeros((len(mine), 1)), np.cumsum(columns, axis=1)], axis=1)
            left, right = table_[:, whole_x], table_[:, whole_x + 1]
            out[mine] = left + (right - left) * part_x
            top = rows[-1]
        else:
            top = top + strip.sum(axis=0, dtype=np.float64)
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means of an (h, w) or (h, w, channels) array, as float64."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], height, width) for c in range(image.shape[2])], axis=2)
    h, w = image.shape
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    s = _integral_at(image, ys, xs)
    return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / ((h / height) * (w / width))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each cell of 8 by 9 area means is darker than the one to its right."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int, top: int = 255) -> bytes:
    """The image's size by size area means, ``top`` as 255, rounded, as the bytes of an NPY file of uint8."""
    tile = np.clip(np.rint(np.round(area_resize(image, size, size) * (255 / top), 6)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def media_tiles(images: DataFrame, id_column: str, data_column: str, size: int = 24) -> DataFrame:
    """(id, height, width, channels, dhash, tile, error) for every row; tile holds an NPY file.

    A null, empty, cut-off or unknown image gives nulls and an error text; it doesn't stop the
    job.  Rows with equal ids keep their own rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "data", 8 * BATCH_BYTES):
            rows: list[tuple] = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    rows.append((image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], difference_hash(image), npy_tile(image, size, maxval(data)), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_column, "height", "width", "channels", "dhash", "tile", "error"]
            )

    rows = images.select(images[id_column], images[data_column].alias("data"))
    kind = images.schema[id_column].dataType.simpleString()
    return map_arrow(rows, run, f"{id_column} {kind}, height int, width int, channels int, dhash string, tile binary, error string")


def payload(text: bytes) -> bytes:
    """The text's bytes, and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def document_media(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A digest of every whole text stored as a greyscale image and read back.

    The payload's samples are the pixels of a PGM file with rows of ROW samples.  Its decoded
    samples are what payload_sha256, tail_crc32 and feature (the difference hash) are made of;
    tile_sha256 is of the NPY tile.  A null text counts as empty: one unit of bytes 255.  Repeated
    rows keep their own rows; an empty table gives an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            rows = []
            for text in utf8(batch.column(1)):
                stored = encode_pgm(np.frombuffer(payload(text), np.uint8).reshape(-1, ROW))
                image = decode(stored)
                back = image.tobytes()
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image, 24)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    rows = docs.select(docs[id_column], docs["text"])
    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(rows, run, f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")


def op6_media_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))
