"""Bloom filter chunks with two derived Murmur hashes."""

from __future__ import annotations

import bisect
import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from cellstrata.format.cells import bytes_of
from cellstrata.format.errors import FormatError
from cellstrata.format.wire import read_vint, write_vint

_M32 = 0xFFFFFFFF
_M = 0x5BD1E995  # fixed value of MurmurHash2


def _signed(h: int) -> int:
    return h - (1 << 32) if h >> 31 else h


def murmur2(key: bytes, seed: int = 0) -> int:
    """MurmurHash2 whose last bytes are taken as signed; a signed 32-bit number."""
    h = (seed ^ len(key)) & _M32
    whole = len(key) // 4 * 4
    for (k,) in struct.iter_unpack("<I", key[:whole]):
        k = k * _M & _M32
        k = (k ^ k >> 24) * _M & _M32
        h = h * _M & _M32 ^ k
    rest = key[whole:]
    for i in reversed(range(len(rest))):
        h ^= ((rest[i] ^ 0x80) - 0x80 << 8 * i) & _M32
    if rest:
        h = h * _M & _M32
    h = (h ^ h >> 13) * _M & _M32
    return _signed(h ^ h >> 15)


def _murmur2(data: np.ndarray, starts: np.ndarray, size: int, seed: np.ndarray | int = 0) -> np.ndarray:
    """:func:`murmur2` of many keys of one size, as unsigned numbers."""
    m = np.uint32(_M)
    keys = data[starts[:, None] + np.arange(size)]
    h = np.zeros(len(starts), np.uint32) ^ np.asarray(seed, np.uint32) ^ np.uint32(size & _M32)
    whole = size // 4 * 4
    for k in np.ascontiguousarray(keys[:, :whole]).view("<u4").T:
        k = k * m
        k = (k ^ k >> np.uint32(24)) * m
        h = h * m ^ k
    for i in range(whole, size):
        h ^= keys[:, i].astype(np.int8).astype(np.int32).view(np.uint32) << np.uint32(8 * (i - whole))
    if whole < size:
        h = h * m
    h = (h ^ h >> np.uint32(13)) * m
    return h ^ h >> np.uint32(15)


def _places(keys: pa.Array, bits: int, hashes: int) -> np.ndarray:
    """[hash, key] -> place in the chunk."""
    data, starts, sizes = bytes_of(keys)
    out = np.empty((hashes, len(keys)), np.int64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        at = _murmur2(data, starts[own], int(size))
        step = _murmur2(data, starts[own], int(size), at)
        for i in range(hashes):
            out[i, own] = np.abs(at.view(np.int32).astype(np.int64)) % bits
            at = at + step
    return out


def chunk_holds(chunk: bytes, keys: pa.Array, hashes: int) -> np.ndarray:
    """Which of the keys the chunk may hold."""
    bits = 8 * len(chunk)
    if not bits:
        return np.zeros(len(keys), bool)
    p = _places(keys, bits, hashes)
    return (np.frombuffer(chunk, np.uint8)[p >> 3] >> (p & 7) & 1).all(axis=0)


def make_chunk(keys: pa.Array, hashes: int, error: float = 0.01) -> bytes:
    size = max(1, math.ceil(-len(keys) * math.log(error) / math.log(2) ** 2 / 8))
    size = 1 << (size - 1).bit_length()
    out = np.zeros(8 * size, np.uint8)
    out[_places(keys, 8 * size, hashes)] = 1
    return np.packbits(out, bitorder="little").tobytes()


@dataclass
class BloomMeta:
    total_bytes: int
    hash_count: int
    hash_type: int
    key_count: int
    max_keys: int
    num_chunks: int
    comparator: str = ""
    chunks: list[tuple[int, int, bytes]] = field(default_factory=list)  # offset, size, first key

    def chunks_of(self, keys: list[bytes]) -> np.ndarray:
        """For each key the last chunk whose first key is at or before it, or -1."""
        begin = [c[2] for c in self.chunks]
        return np.array([bisect.bisect_right(begin, k) - 1 for k in keys], np.int64)


_HEAD = ">iqiiqqi"


def parse_meta(b: bytes, read_entries) -> BloomMeta:
    size = struct.calcsize(_HEAD)
    if len(b) < size:
        raise FormatError("bloom meta cut short")
    version, *numbers = struct.unpack_from(_HEAD, b)
    if version != 3:
        raise FormatError(f"bloom version {version}")
    n, at = read_vint(b, size)
    if n < 0 or at + n > len(b):
        raise FormatError("bloom comparator past the end")
    out = BloomMeta(*numbers, b[at : at + n].decode("latin-1"))
    if not 0 <= out.hash_count <= 255:
        raise FormatError("bloom hash count")
    out.chunks = read_entries(b[at + n :], out.num_chunks)[0]
    return out


def format_meta(meta: BloomMeta, format_entries) -> bytes:
    name = meta.comparator.encode()
    head = struct.pack(_HEAD, 3, meta.total_bytes, meta.hash_count, meta.hash_type, meta.key_count, meta.max_keys, meta.num_chunks)
    return head + write_vint(len(name)) + name + format_entries(meta.chunks)
