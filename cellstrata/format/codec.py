"""Block compression. Snappy and most zstd data come in frames of blocks and chunks."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
import zstandard

from cellstrata.format.errors import FormatError

# Codec numbers of the trailer.
GZ, NONE, SNAPPY, ZSTD = 1, 2, 3, 6
CODECS = {"GZ": GZ, "NONE": NONE, "SNAPPY": SNAPPY, "ZSTD": ZSTD}
NAMES = {v: k for k, v in CODECS.items()}
_ZSTD_MAGIC = bytes.fromhex("28b52ffd")
_LARGEST = 1 << 30


def _gunzip(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj(31).decompress(data, size) if size else b""
    except zlib.error as e:
        raise FormatError(f"gzip: {e}") from None


def _unsnap(chunk: bytes, room: int) -> bytes:
    size, shift, at = 0, 0, 0
    while True:  # the preamble tells the size
        if at >= len(chunk) or shift > 28:
            raise FormatError("snappy: bad preamble")
        size |= (chunk[at] & 0x7F) << shift
        at += 1
        if chunk[at - 1] < 0x80:
            break
        shift += 7
    if size > room:
        raise FormatError("snappy: more than announced")
    try:
        return pa.decompress(chunk, decompressed_size=size, codec="snappy", asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise FormatError(f"snappy: {e}") from None


def _unzstd(chunk: bytes, room: int) -> bytes:
    try:
        out = zstandard.ZstdDecompressor().decompressobj().decompress(chunk)
    except zstandard.ZstdError as e:
        raise FormatError(f"zstd: {e}") from None
    if len(out) > room:
        raise FormatError("zstd: more than announced")
    return out


def _frames(data: bytes, size: int, chunk_of) -> bytes:
    """[decompressed size u32 ([chunk size u32] [chunk])*]*"""
    out, at = bytearray(), 0
    while len(out) < size:
        if at + 4 > len(data):
            raise FormatError("compressed block cut short")
        (block,) = struct.unpack_from(">I", data, at)
        at += 4
        if block > size - len(out):
            raise FormatError("compressed block larger than announced")
        end = len(out) + block
        while len(out) < end:
            if at + 4 > len(data):
                raise FormatError("compressed block cut short")
            (n,) = struct.unpack_from(">I", data, at)
            at += 4
            if at + n > len(data):
                raise FormatError("compressed chunk cut short")
            got = chunk_of(data[at : at + n], end - len(out))
            if not got:
                raise FormatError("empty compressed chunk")
            out += got
            at += n
    return bytes(out)


_more: dict[int, tuple] = {}


def register(number: int, name: str, unpack, pack) -> None:
    """Adds a codec of the trailer's numbering: ``unpack(data, size)`` and ``pack(data)``, both of whole block bodies.

    Workers need it too: call it where tasks import it, as in a module that is shipped to them.
    """
    if number in NAMES or name in CODECS:
        raise ValueError(f"codec {number} ({name}) is known already")
    CODECS[name], NAMES[number], _more[number] = number, name, (unpack, pack)


def decompress(codec: int, data: bytes, size: int) -> bytes:
    if codec not in NAMES:
        raise FormatError(f"compression codec {codec} is not supported")
    if not 0 <= size <= _LARGEST:
        raise FormatError(f"block of {size} bytes")
    if codec in _more:
        out = _more[codec][0](data, size)
    elif codec == NONE:
        out = data
    elif codec == GZ:
        out = _gunzip(data, size)
    elif codec == SNAPPY:
        out = _frames(data, size, _unsnap)
    elif data[:4] == _ZSTD_MAGIC:
        out = _unzstd(data, size)
    else:
        out = _frames(data, size, _unzstd)
    if len(out) != size:
        raise FormatError(f"block of {len(out)} bytes where {size} were announced")
    return out


def compress(codec: int, data: bytes, framed: bool = True) -> bytes:
    if codec in _more:
        return _more[codec][1](data)
    if codec == NONE:
        return data
    if codec == GZ:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()
    if codec == SNAPPY:
        body = pa.compress(data, codec="snappy", asbytes=True)
    elif codec == ZSTD:
        body = zstandard.ZstdCompressor(level=3).compress(data)
        if not framed:
            return body
    else:
        raise FormatError(f"compression codec {codec} is not supported")
    return struct.pack(">II", len(data), len(body)) + body if data else b""
