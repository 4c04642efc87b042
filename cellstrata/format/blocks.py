"""Blocks: a 33-byte header, the payload as stored, and its checksums."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from cellstrata.format import checksum, codec
from cellstrata.format.errors import FormatError

# The magic of each block type.
MAGICS = {
    "DATA": b"DATABLK*",
    "ENCODED_DATA": b"DATABLKE",
    "LEAF_INDEX": b"IDXLEAF2",
    "BLOOM_CHUNK": b"BLMFBLK2",
    "META": b"METABLKc",
    "INTERMEDIATE_INDEX": b"IDXINTE2",
    "ROOT_INDEX": b"IDXROOT2",
    "FILE_INFO": b"FILEINF2",
    "GENERAL_BLOOM_META": b"BLMFMET2",
    "DELETE_FAMILY_BLOOM_META": b"DFBLMET2",
    "TRAILER": b'TRABLK"$',
    "INDEX_V1": b"IDXBLK)+",
}
TYPES = {v: k for k, v in MAGICS.items()}
HEADER = struct.Struct(">8siiqBii")
PER_CHECKSUM = 16384


@dataclass
class Header:
    type: str
    on_disk_size: int  # without the header
    uncompressed_size: int
    previous_offset: int
    checksum_type: int
    bytes_per_checksum: int
    data_size: int  # with the header, without checksums


def parse_header(b: bytes) -> Header:
    magic, *rest = HEADER.unpack(b)
    if magic not in TYPES:
        raise FormatError(f"unknown block magic {magic!r}")
    return Header(TYPES[magic], *rest)


def read_block(f, offset: int, compression: int, verify: bool = True) -> tuple[Header, bytes, int]:
    """Header, payload and the offset of what follows."""
    raw = f.read_at(offset, HEADER.size)
    head = parse_header(raw)
    stored = head.data_size - HEADER.size
    if stored < 0 or head.on_disk_size < stored or head.uncompressed_size < 0:
        raise FormatError("block sizes do not fit")
    body = f.read_at(offset + HEADER.size, head.on_disk_size)
    if verify:
        checksum.verify(head.checksum_type, head.bytes_per_checksum, raw + body[:stored], body[stored:])
    return head, codec.decompress(compression, body[:stored], head.uncompressed_size), offset + HEADER.size + head.on_disk_size


def format_block(kind: str, data: bytes, compression: int = codec.NONE, previous: int = -1, checksum_type: int = checksum.CRC32C, framed: bool = True) -> bytes:
    stored = codec.compress(compression, data, framed)
    size = HEADER.size + len(stored)
    sums = 4 * -(-size // PER_CHECKSUM) if checksum_type else 0
    head = HEADER.pack(MAGICS[kind], len(stored) + sums, len(data), previous, checksum_type, PER_CHECKSUM, size)
    return head + stored + checksum.checksums(checksum_type, PER_CHECKSUM, head + stored)
