"""Media columns: PNG bytes in binary columns, decoded and hashed.

The decoder walks the chunks of a PNG, tests every checksum, inflates the IDAT
data and undoes the row filters with numpy.  The feature is a perceptual hash:
the signs of the 8 x 8 low-frequency cosine coefficients of the grey picture
against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.common import materialize, small_batches

#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

ROW = 192  # bytes of a picture row: 64 pixels of three samples
CHUNK = 1 << 16

_FEATURES = [
    ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()),
    ("feature", pa.string()),
    ("media_error", pa.string()),
]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """samples: height x width x channels of uint8; every row takes the filter
    (none, sub or up) with the least sum of absolute values."""
    height, width, channels = samples.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    flat = samples.reshape(height, width * channels)
    sub, up = flat.copy(), flat.copy()
    sub[:, channels:] -= flat[:, :-channels]
    up[1:] -= flat[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (flat, sub, up)]
    best = np.argmin(cost, axis=0).astype(np.uint8)
    raw = np.empty((height, 1 + width * channels), np.uint8)
    raw[:, 0] = best
    raw[:, 1:] = np.where((best == 0)[:, None], flat, np.where((best == 1)[:, None], sub, up))
    packed = zlib.compress(raw.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", header) + body + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def unfilter(rows: np.ndarray, filters: np.ndarray, channels: int) -> np.ndarray:
    """Undo the row filters: runs of none, sub or up at once, average and Paeth
    sample by sample, as each needs its left neighbour."""
    out = rows.copy()
    height, width = rows.shape
    edges = np.flatnonzero(np.diff(filters)) + 1
    for lo, hi in zip([0, *edges], [*edges, height], strict=True):
        kind = filters[lo]
        if kind == 1:
            part = out[lo:hi].reshape(hi - lo, -1, channels)
            out[lo:hi] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(hi - lo, width)
        elif kind == 2:
            if lo:
                out[lo] += out[lo - 1]
            out[lo:hi] = np.cumsum(out[lo:hi], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(lo, hi):
                above = out[y - 1].tolist() if y else [0] * width
                row = out[y].tolist()
                for x in range(width):
                    left = row[x - channels] if x >= channels else 0
                    if kind == 3:
                        row[x] = (row[x] + (left + above[x]) // 2) & 255
                    else:
                        corner = above[x - channels] if x >= channels else 0
                        row[x] = (row[x] + _paeth(left, above[x], corner)) & 255
                out[y] = row
        elif kind != 0:
            raise ValueError(f"unknown row filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """height x width x channels of uint8; ValueError says what is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if header is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or interlace or colour not in CHANNELS or not width or not height:
        raise ValueError("only plain pictures of 8-bit samples, without a palette, are read")
    channels = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (1 + width * channels):
        raise ValueError("sample data of the wrong length")
    table = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter(table[:, 1:], table[:, 0], channels).reshape(height, width, channels)


@lru_cache(1)
def _cosines(n: int = 32, keep: int = 8) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def _shrink(grey: np.ndarray, n: int = 32) -> np.ndarray:
    """Means over n equal parts of the first axis (a short axis repeats)."""
    size = len(grey)
    lo = np.arange(n) * size // n
    hi = np.maximum(lo + 1, (np.arange(n) + 1) * size // n)
    sums = np.concatenate([np.zeros((1, grey.shape[1])), np.cumsum(grey, axis=0, dtype=np.float64)])
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """Sixteen hex digits: the 64 low-frequency signs."""
    rgb = samples.astype(np.int32)
    grey = (299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2]) // 1000 if samples.shape[2] >= 3 else rgb[..., 0]
    small = _shrink(_shrink(grey).T).T
    c = _cosines()
    low = (c @ small @ c.T).ravel().round(6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def pad(payload: bytes) -> bytes:
    """To a positive multiple of a picture row, with spaces."""
    return payload + b" " * (-len(payload) % ROW if payload else ROW)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [x.encode() for x in batch["text"].to_pylist()]
        media = [encode_png(np.frombuffer(pad(x), np.uint8).reshape(-1, ROW // 3, 3)) for x in raw]
        columns = [batch["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])


def text_pictures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the padded UTF-8 of each text as PNG samples.

    The table is written to the shared folder and read back from there.  A null
    text counts as empty; null and repeated identifiers come through; an empty
    table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """All columns but the pictures, and what decoding them gives.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 16) are of the
    samples read back, media_bytes and media_sha256 of the stored form, feature
    is the cosine hash.  A null or broken picture gives nulls and says why in
    media_error; it doesn't stop the others.
    """
    small_batches(media.sparkSession)
    others = [c for c in media.columns if c != media_col and c not in dict(_FEATURES)]

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + ("null",)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            samples = decode_png(data)
        except ValueError as e:
            return (None, None, None, *stored, None, str(e))
        back = samples.tobytes()
        return (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), *stored, cosine_hash(samples), None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*map(features, batch[media_col].to_pylist()), strict=True)) or [()] * len(_FEATURES)
            columns = [pa.array(x, kind) for x, (_, kind) in zip(got, _FEATURES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), *columns], [*others, *dict(_FEATURES)])

    schema = T.StructType([media.schema[c] for c in others])
    for name, kind in _FEATURES:
        schema = schema.add(name, T.LongType() if kind == pa.int64() else T.StringType())
    return media.select(*others, media_col).mapInArrow(read, schema)
