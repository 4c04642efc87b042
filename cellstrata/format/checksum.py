"""CRC32 and CRC32C of block chunks.

CRC32C is linear, so a piece's checksum is the exclusive or of one table entry per byte, by
the byte's distance from the end; numpy gathers and folds them.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

from cellstrata.format.errors import FormatError

# Checksum types of the block header, and the reflected Castagnoli polynomial.
NULL, CRC32, CRC32C = 0, 1, 2
_POLYNOMIAL = 0x82F63B78
_PIECE = 4096


@functools.cache
def _tables() -> np.ndarray:
    """[distance from the end, byte] -> effect on the checksum."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, row >> 1 ^ _POLYNOMIAL, row >> 1).astype(np.uint32)
    out = np.empty((_PIECE, 256), dtype=np.uint32)
    out[0] = row
    for i in range(1, _PIECE):
        out[i] = out[i - 1] >> 8 ^ row[out[i - 1] & 0xFF]
    return out


def crc32c(data: bytes) -> int:
    tables = _tables()
    state = 0xFFFFFFFF
    for at in range(0, len(data), _PIECE):
        piece = np.frombuffer(data, np.uint8, min(_PIECE, len(data) - at), at).copy()
        lead = min(4, len(piece))
        piece[:lead] ^= np.frombuffer(state.to_bytes(4, "little"), np.uint8)[:lead]
        n = len(piece)
        folded = int(np.bitwise_xor.reduce(tables[np.arange(n - 1, -1, -1), piece]))
        state = folded ^ (state >> (8 * n) if n < 4 else 0)
    return state ^ 0xFFFFFFFF


def checksum(kind: int, chunk: bytes) -> int:
    if kind == CRC32:
        return zlib.crc32(chunk)
    if kind == CRC32C:
        return crc32c(chunk)
    raise FormatError(f"checksum type {kind} is not supported")


def checksums(kind: int, per: int, data: bytes) -> bytes:
    if kind == NULL:
        return b""
    return b"".join(checksum(kind, data[i : i + per]).to_bytes(4, "big") for i in range(0, len(data), per))


def verify(kind: int, per: int, data: bytes, stored: bytes) -> None:
    if kind == NULL:
        return
    if per <= 0:
        raise FormatError(f"{per} bytes a checksum")
    if len(stored) < 4 * -(-len(data) // per):
        raise FormatError("checksums cut short")
    for i, at in enumerate(range(0, len(data), per)):
        if checksum(kind, data[at : at + per]) != int.from_bytes(stored[4 * i : 4 * i + 4], "big"):
            raise FormatError(f"checksum mismatch in chunk {i}")
