"""Vectorised text kernels on Arrow buffers, shared by the Python-side operators.

A *piece* is a run of rows with a bounded number of text bytes, so the temporaries of
one call stay bounded however long a batch is (one longer text is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 2 << 20
U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], dtype=U64)

#: Bytes mapped with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place where it can."""
    h = h ^ (h >> U64(30))
    h *= _M2
    h ^= h >> U64(27)
    h *= _M3
    h ^= h >> U64(31)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    a = texts.cast(pa.large_binary())
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(a) else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def spans(buf: np.ndarray, offs: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with part[byte], never across texts: starts, ends, and each text's first run (n + 1)."""
    n = len(buf)
    inside = part[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def hash_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, eight bytes a step; equal bytes give equal hashes anywhere."""
    size = (e - s).astype(np.int64)
    h = size.astype(U64) * _M1
    if not len(s):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, at, left = np.arange(len(s)), s.astype(np.int64), size
    while len(live):
        got = words[at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ got) * _M1 + _M3)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def same_spans(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[sa : sa + size] equals b[sb : sb + size], byte for byte."""
    same = np.ones(len(sa), dtype=bool)
    pad = np.zeros(8, np.uint8)
    pa_, pb_ = np.concatenate([a, pad]), np.concatenate([b, pad])
    wa = np.ndarray((len(a) + 1,), dtype="<u8", buffer=pa_, strides=(1,))
    wb = np.ndarray((len(b) + 1,), dtype="<u8", buffer=pb_, strides=(1,))
    live, x, y, left = np.arange(len(sa)), sa.astype(np.int64), sb.astype(np.int64), size.astype(np.int64)
    while len(live):
        eq = (wa[x] ^ wb[y]) & _MASKS[np.minimum(left, 8)] == 0
        same[live[~eq]] = False
        more = eq & (left > 8)
        live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
    return same


def owner(first: np.ndarray) -> np.ndarray:
    """For n + 1 first positions, the text that each position belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the word each starts at; short: a text of fewer words is one shingle."""
    n = len(h)
    if not n:
        return h[:0], np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= end)
    g = mix(h[at] + U64(k * int(_M2) % (1 << 64)))
    for j in range(1, k):
        g = mix(g * _M1 + h[at + j])
    if short:
        size = np.diff(first)
        few = np.flatnonzero((size > 0) & (size < k))
        if len(few):
            own = np.zeros(len(few), dtype=U64)
            for i, d in enumerate(few):
                x = mix(h[first[d] : first[d] + 1] + U64(int(size[d]) * int(_M2) % (1 << 64)))
                for w in h[first[d] + 1 : first[d + 1]]:
                    x = mix(x * _M1 + w)
                own[i] = x[0]
            at = np.concatenate([at, first[few]])
            g = np.concatenate([g, own])
            order = np.argsort(at, kind="stable")
            at, g = at[order], g[order]
    return g, at


def offsets_of(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32())


def annotate(docs: DataFrame, fn: Callable, fields: list[T.StructField], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Run ``fn`` over pieces of (row, text) batches and return ``row`` beside ``fields``.

    ``row`` holds the kept columns (all by default) as a struct, so they never clash with the new ones.
    """
    cols = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    df = docs.select(row, F.col(f"`{text}`").alias("text"))
    return df.mapInArrow(fn, T.StructType([df.schema["row"], *fields]))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *[len(a) for a in arrays], *[a.dtype.itemsize for a in arrays]], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    out, at = [], head.nbytes
    for size, width, kind in zip(head[1 : 1 + n].tolist(), head[1 + n :].tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * width
    return out


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """Splits hashes evenly by their upper halves; the lower half names one within its bucket."""
    return ((x >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
