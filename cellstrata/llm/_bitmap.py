"""Bitmaps of hashes: broadcast screens of a size that follows the hashes' number up to a bound.

A bitmap has a bit for every hash it was made of, and some more: what it lets through in error has
to be harmless but for its cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellstrata.llm import _text as X

LEAST, MOST = 1 << 16, 1 << 28  # bits


def bits_for(count: int, most: int = MOST) -> int:
    """A power of two of 16 bits a hash or more, within bounds."""
    return min(most, max(LEAST, 1 << (16 * max(count, 1) - 1).bit_length()))


def place(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = X.mix(h.copy()) % X.U64(bits)
    return (at >> X.U64(6)).astype(np.int64), at & X.U64(63)


def holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    word, bit = place(h, 64 * len(bitmap))
    return (bitmap[word] >> bit & X.U64(1)).astype(bool)


def collect(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a column of longs, as words; what reaches the driver is bits / 64 words, whatever the rows."""

    def set_bits(batches):
        for b in batches:
            word, bit = place(np.asarray(b.column(0)).view(X.U64), bits)
            word, back = np.unique(word, return_inverse=True)
            held = np.zeros(len(word), dtype=X.U64)
            np.bitwise_or.at(held, back, X.U64(1) << bit)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], ["w", "b"])

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([X.pack(np.asarray(b.column(0)), np.asarray(b.column(1)))], pa.binary())], ["packed"])

    out = np.zeros(bits // 64, dtype=X.U64)
    words = hashes.mapInArrow(set_bits, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    for r in words.mapInArrow(packed, "packed binary").toLocalIterator():
        w, b = X.unpack(r.packed, np.int64, np.int64)
        out[w] = b.view(X.U64)
    return out
