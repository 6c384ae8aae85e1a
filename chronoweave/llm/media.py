"""Media columns: texts as grey PNG images in a binary column, read back and hashed by low frequencies.

A payload is the text's UTF-8 bytes, padded with zero bytes to a positive multiple of the image width. The image
has one 8-bit grey sample for each byte. Reading tests the signature, every chunk's CRC, the header and zlib's own
checksum, and undoes any of the five row filters with numpy. The feature is a 64-bit hash of signs of the lowest
cosine frequencies of a 32 x 32 mean image.

Defined cases: null text counts as empty; an empty text is one row of zero samples; equal texts give equal media
and features; repeated rows are kept; null ids stay null; an empty table gives an empty result; other columns of
the input are not read. Memory is bounded by STEP_BYTES of text or one text.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import batch, binary, pieces, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, IDAT, LEVEL, SIDE, LOW = 64, 1 << 16, 6, 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Rows under filter 0 (none), 1 (left) or 2 (above), without the filter byte."""
    if kind == 0:
        return rows
    out = rows.copy()
    if kind == 1:
        out[:, 1:] -= rows[:, :-1]
    else:
        out[1:] -= rows[:-1]
    return out


def _entropy(samples: np.ndarray) -> float:
    n = np.bincount(samples.reshape(-1), minlength=256)
    p = n[n > 0] / max(1, samples.size)
    return float(-(p * np.log2(p)).sum())


def write_png(rows: np.ndarray, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG; its filter is the one of none, left and above with the least byte entropy."""
    height, width = rows.shape
    kind = min((0, 1, 2), key=lambda k: (round(_entropy(_filtered(rows, k)), 9), k))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, _filtered(rows, kind)
    packed = zlib.compress(lines.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo PNG row filters. Runs of equal filters are undone together where the filter allows it."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if not kinds.any():
        return rows
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for begin, end in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind, part = int(kinds[begin]), rows[begin:end]
        above = rows[begin - 1] if begin else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            rows[begin:end] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            rows[begin:end] = np.cumsum(np.vstack([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(begin, end):
                rows[y] = _average(rows[y], above) if kind == 3 else _paeth(rows[y], above)
                above = rows[y]
        elif kind:
            raise ValueError(f"unknown PNG filter {kind}")
    return rows


def _average(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = np.empty_like(line), 0
    for x, (v, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        out[x] = left = (v + (left + up) // 2) & 255
    return out


def _paeth(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = np.empty_like(line), 0, 0
    for x, (v, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        near = sorted(((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner)))[0][2]
        out[x] = left = (v + near) & 255
        corner = up
    return out


def read_png(media: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG. Raises ValueError at any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(media):
        size = struct.unpack_from(">I", media, at)[0]
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or zlib.crc32(media[at + 4 : at + 8 + size]) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            ended = True
            break
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no grey 8-bit image, or cut off")
    try:
        lines = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("damaged samples") from e
    width, height = head[:2]
    if len(lines) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(np.frombuffer(lines, np.uint8).reshape(height, width + 1))


@lru_cache(1)
def _cosines() -> np.ndarray:
    x = np.arange(SIDE)
    return np.cos(np.pi * (2 * x[None] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _shrunk(rows: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Means of ``side`` even parts along an axis; samples are repeated where there are fewer."""
    n = rows.shape[axis]
    if n < side:
        return np.take(rows, np.arange(side) * n // side, axis)
    cuts = np.arange(side + 1) * n // side
    sums = np.add.reduceat(rows, cuts[:-1], axis)
    widths = np.diff(cuts)
    return sums / (widths[:, None] if axis == 0 else widths[None])


def feature(rows: np.ndarray) -> str:
    """16 hex digits: for each of the 8 x 8 lowest cosine frequencies, whether it is above their median."""
    small = _shrunk(_shrunk(rows.astype(np.int64), SIDE, 0), SIDE, 1)
    low = np.round(_cosines() @ small @ _cosines().T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


WRITTEN = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string())])


def _write(batches):
    for b in pieces(batches, 1):
        raw, at = utf8(b.column(1))
        media = []
        for i in range(b.num_rows):
            text = raw[at[i] : at[i + 1]]
            padded = np.zeros(max(1, -(-len(text) // WIDTH)) * WIDTH, np.uint8)
            padded[: len(text)] = text
            media.append(write_png(padded.reshape(-1, WIDTH)))
        yield batch(WRITTEN, b.column(0), np.diff(at), binary(media))


def _read(batches):
    for b in pieces(batches, 2):
        payload, features = [], []
        for x in b.column(2):
            rows = read_png(x.as_py())
            payload.append(rows.tobytes())
            features.append(feature(rows))
        yield batch(READ, b.column(0), b.column(1), b.column(2), binary(payload), features)


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text) and media (PNG, binary) for every row."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame) -> DataFrame:
    """Adds payload (the samples read back, binary) and feature to what write_media() returns."""
    return df.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, media binary, payload binary, feature string")
