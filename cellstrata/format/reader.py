"""Cell files: trailer, load-on-open section, index tree, cells."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa

from cellstrata.format import bloom, cells, codec
from cellstrata.format.blocks import HEADER, MAGICS, Header, parse_header, read_block
from cellstrata.format.errors import FormatError
from cellstrata.format.wire import decode_message, last, read_varint, read_vint

TRAILER_SIZE = 4096
MAJOR = 3
_LEVELS = 32


@dataclass
class Trailer:
    major: int
    minor: int
    file_info_offset: int = 0
    load_on_open_offset: int = 0
    uncompressed_index_size: int = 0
    total_uncompressed_bytes: int = 0
    data_index_count: int = 0
    meta_index_count: int = 0
    entry_count: int = 0
    data_index_levels: int = 0
    first_data_block_offset: int = 0
    last_data_block_offset: int = 0
    comparator: str = ""
    compression: int = 0
    encryption_key: bytes = b""


def read_trailer(f) -> Trailer:
    if f.size < TRAILER_SIZE:
        raise FormatError("file shorter than a trailer")
    b = f.read_at(f.size - TRAILER_SIZE, TRAILER_SIZE)
    version = int.from_bytes(b[-4:], "big")
    if version & 0xFFFFFF != MAJOR:
        raise FormatError(f"file version {version & 0xFFFFFF}")
    if b[:8] != MAGICS["TRAILER"]:
        raise FormatError("no trailer")
    size, at = read_varint(b, 8)
    if at + size > TRAILER_SIZE - 4:
        raise FormatError("trailer message past its end")
    m = decode_message(b[at : at + size])
    out = Trailer(MAJOR, version >> 24)
    for field, name in enumerate(list(asdict(out))[2:12], 1):
        setattr(out, name, last(m, field, 0, int))
    out.comparator = last(m, 11, b"", bytes).decode("utf-8", "replace")
    out.compression = last(m, 12, 0, int)
    out.encryption_key = last(m, 13, b"", bytes)
    return out


def parse_entries(b: bytes, count: int) -> tuple[list[tuple[int, int, bytes]], int]:
    """Entries of a root index and where they end: offset i64, size i32, key length, key."""
    if not 0 <= count <= len(b):
        raise FormatError("index count")
    out, at = [], 0
    for _ in range(count):
        if at + 12 > len(b):
            raise FormatError("index cut short")
        offset, size = struct.unpack_from(">qi", b, at)
        n, at = read_vint(b, at + 12)
        if n < 0 or at + n > len(b):
            raise FormatError("index key past the end")
        out.append((offset, size, b[at : at + n]))
        at += n
    return out, at


def format_entries(entries: list[tuple[int, int, bytes]]) -> bytes:
    from cellstrata.format.wire import write_vint

    return b"".join(struct.pack(">qi", o, s) + write_vint(len(k)) + k for o, s, k in entries)


def parse_non_root(b: bytes) -> list[tuple[int, int, bytes]]:
    """Entries of a leaf or intermediate index: a count, count + 1 relative offsets, then the entries."""
    if len(b) < 4:
        raise FormatError("index cut short")
    (n,) = struct.unpack_from(">i", b)
    if n < 0 or 4 + 4 * (n + 1) > len(b):
        raise FormatError("index count")
    places = struct.unpack_from(f">{n + 1}i", b, 4)
    base = 4 + 4 * (n + 1)
    out = []
    for lo, hi in zip(places, places[1:], strict=False):
        if lo < 0 or hi - lo < 12 or base + hi > len(b):
            raise FormatError("index offsets do not fit")
        offset, size = struct.unpack_from(">qi", b, base + lo)
        out.append((offset, size, b[base + lo + 12 : base + hi]))
    return out


def parse_file_info(b: bytes) -> dict[str, bytes]:
    if b[:4] != b"PBUF":
        raise FormatError("file info magic")
    size, at = read_varint(b, 4)
    if at + size > len(b):
        raise FormatError("file info past its end")
    out = {}
    for entry in decode_message(b[at : at + size]).get(1, []):
        if not isinstance(entry, bytes):
            raise FormatError("file info entry")
        pair = decode_message(entry)
        out[last(pair, 1, b"", bytes).decode("utf-8", "replace")] = last(pair, 2, b"", bytes)  # the last of a key counts
    return out


# File info keys that reading depends on.
TAGS_KEY, ENCODING_KEY, BLOOM_KEY = "hfile.MAX_TAGS_LEN", "DATA_BLOCK_ENCODING", "BLOOM_FILTER_TYPE"


def cell_data(head: Header, data: bytes, encoding: str) -> bytes:
    """The cells' bytes of a data block."""
    if encoding == "FAST_DIFF":
        if head.type != "ENCODED_DATA" or len(data) < 2 or data[:2] != b"\x00\x04":
            raise FormatError("block is not encoded as its file")
        return data[2:]
    if head.type != "DATA":
        raise FormatError(f"{head.type} block where DATA is due")
    return data


def block_columns(f, offset: int, layout: tuple[int, str, bool], verify: bool = True, values: bool = True) -> cells.Columns:
    """A data block's cells as arrays; ``layout`` as the open file told it."""
    compression, encoding, tagged = layout
    head, data, _ = read_block(f, offset, compression, verify)
    return (cells.fast_diff_columns if encoding == "FAST_DIFF" else cells.plain_columns)(cell_data(head, data, encoding), tagged, values)


class CellFile:
    """An open cell file; everything but cells is read at once."""

    def __init__(self, f, verify: bool = True):
        self.f, self.verify = f, verify
        self.trailer = t = read_trailer(f)
        if t.compression not in codec.NAMES:
            raise FormatError(f"compression codec {t.compression} is not supported")
        if t.encryption_key:
            raise FormatError("encrypted files are not supported")
        if t.data_index_levels > _LEVELS:
            raise FormatError(f"index of {t.data_index_levels} levels")
        at = t.load_on_open_offset
        root, at = self._open(at, "ROOT_INDEX")
        self.index, end = parse_entries(root, t.data_index_count)
        self.mid_key = root[end:] if t.data_index_levels > 1 else b""
        meta, at = self._open(at, "ROOT_INDEX")
        self.meta_index = parse_entries(meta, t.meta_index_count)[0]
        info, at = self._open(at, "FILE_INFO")
        self.file_info = parse_file_info(info)
        self.tagged = len(self.file_info.get(TAGS_KEY, b"")) == 4 and int.from_bytes(self.file_info[TAGS_KEY], "big", signed=True) > 0
        self.encoding = self.file_info.get(ENCODING_KEY, b"NONE").decode("latin-1")
        if self.encoding not in ("NONE", "FAST_DIFF"):
            raise FormatError(f"data block encoding {self.encoding} is not supported")
        self.bloom = None
        if at + HEADER.size <= f.size - TRAILER_SIZE and f.read_at(at, 8) == MAGICS["GENERAL_BLOOM_META"]:
            self.bloom = bloom.parse_meta(self._open(at, "GENERAL_BLOOM_META")[0], parse_entries)

    def _open(self, at: int, kind: str) -> tuple[bytes, int]:
        head, data, after = read_block(self.f, at, self.trailer.compression, self.verify)
        if head.type != kind:
            raise FormatError(f"{head.type} block where {kind} is due")
        return data, after

    def data_blocks(self) -> list[tuple[int, int, bytes]]:
        """Offset, size and first key of all data blocks in order, from the whole index tree."""
        level = self.index
        for depth in range(1, self.trailer.data_index_levels):
            below = []
            for offset, _, _ in level:
                head, data, _ = read_block(self.f, offset, self.trailer.compression, self.verify)
                if head.type not in ("LEAF_INDEX", "INTERMEDIATE_INDEX"):
                    raise FormatError(f"{head.type} block in the index")
                below += parse_non_root(data)
            level = below
            if len(level) > 1 << 26:
                raise FormatError("index too large")
        return level

    def _block(self, offset: int) -> bytes:
        head, data, _ = read_block(self.f, offset, self.trailer.compression, self.verify)
        return cell_data(head, data, self.encoding)

    def block_cells(self, offset: int) -> Iterator[cells.Cell]:
        return (cells.parse_fast_diff if self.encoding == "FAST_DIFF" else cells.parse_plain)(self._block(offset), self.tagged)

    def layout(self) -> tuple[int, str, bool]:
        """What reading a data block needs to know."""
        return self.trailer.compression, self.encoding, self.tagged

    def scan(self) -> Iterator[cells.Cell]:
        for offset, _, _ in self.data_blocks():
            yield from self.block_cells(offset)

    def scan_from(self, key: bytes) -> Iterator[cells.Cell]:
        """Cells from the first whose raw key is at or after ``key`` on."""
        blocks = self.data_blocks()
        want = cells.raw_compare_key(key)
        at = max(0, bisect.bisect_right([cells.raw_compare_key(k) for _, _, k in blocks], want) - 1)
        found = False
        for offset, _, _ in blocks[at:]:
            for c in self.block_cells(offset):
                found = found or cells.raw_compare_key(cells.key_of(c)) >= want
                if found:
                    yield c

    def may_contain(self, key: bytes) -> bool:
        return bool(self.may_contain_all([key])[0])

    def may_contain_all(self, keys: list[bytes]) -> np.ndarray:
        """Which of many keys the filter lets through; each chunk that one falls in is read once."""
        out = np.ones(len(keys), bool)
        if self.bloom is None or not self.bloom.num_chunks:
            return out
        chunk = self.bloom.chunks_of(keys)
        out[chunk < 0] = False
        known = pa.array(keys, pa.binary())
        for i in np.unique(chunk[chunk >= 0]):
            own = np.flatnonzero(chunk == i)
            head, data, _ = read_block(self.f, self.bloom.chunks[i][0], self.trailer.compression, self.verify)
            if head.type != "BLOOM_CHUNK":
                raise FormatError(f"{head.type} block where BLOOM_CHUNK is due")
            out[own] = bloom.chunk_holds(data, known.take(pa.array(own)), self.bloom.hash_count)
        return out

    def blocks(self) -> Iterator[tuple[int, Header]]:
        """Headers of all blocks from the start of the file to the trailer."""
        at = 0
        while at + HEADER.size <= self.f.size - TRAILER_SIZE:
            head = parse_header(self.f.read_at(at, HEADER.size))
            if head.on_disk_size < 0:
                raise FormatError("block sizes do not fit")
            yield at, head
            at += HEADER.size + head.on_disk_size


def row_prefix(row: bytes) -> bytes:
    """A seek key that is before all cells of a row."""
    return struct.pack(">H", len(row)) + row
