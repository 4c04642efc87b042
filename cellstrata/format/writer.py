"""Writes cell files: data blocks with bloom chunks between, leaf indexes if asked for, load-on-open section, trailer."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cellstrata.format import bloom, cells, codec
from cellstrata.format.blocks import MAGICS, format_block
from cellstrata.format.reader import TRAILER_SIZE, format_entries
from cellstrata.format.wire import encode_message, write_varint

PIECE = 8 << 20
_COMPARATOR = "org.apache.hadoop.hbase.CellComparatorImpl"  # fixed value: what readers of the format expect


def _non_root(entries: list[tuple[int, int, bytes]]) -> bytes:
    body = [struct.pack(">qi", o, s) + k for o, s, k in entries]
    places = [0]
    for b in body:
        places.append(places[-1] + len(b))
    return struct.pack(f">i{len(places)}i", len(body), *places) + b"".join(body)


def _row(c: cells.Columns, i: int) -> cells.Cell:
    row, family, qualifier, ts, kind, value, tags = (x[i].as_py() for x in c)
    return cells.Cell(row, family, qualifier, ts % (1 << 64), kind, value, tags)


def _checked(c: cells.Columns) -> list[np.ndarray]:
    """The sizes of rows, families, qualifiers, values and tags, once all fit the format."""
    if any(x.null_count for x in c):
        raise ValueError("a cell's field is null")
    row, family, qualifier, value, tags = sizes = [cells.bytes_of(x)[2] for x in (c.row, c.family, c.qualifier, c.value, c.tags)]
    kind = c.type.to_numpy()
    if (row > 0xFFFF).any() or (family > 0xFF).any() or (tags > 0xFFFF).any() or (kind < 0).any() or (kind > 0xFF).any():
        raise ValueError("a cell's field is larger than the format has room for")
    return sizes


def _in_order(c: cells.Columns) -> bool:
    """Whether the cells stand in the cell order."""
    ts = c.ts.to_numpy().view(np.uint64)
    kind = c.type.to_numpy()
    fit = kind[1:] <= kind[:-1]
    fit = (ts[1:] < ts[:-1]) | (ts[1:] == ts[:-1]) & fit
    for x in (c.qualifier, c.family, c.row):
        fit = np.asarray(pc.greater(x[1:], x[:-1])) | np.asarray(pc.equal(x[1:], x[:-1])) & fit
    return bool(fit.all())


class FileWriter:
    """Writes a file to a stream as its cells come.

    Held are the cells of a block, the rows of a bloom chunk, and an index entry for each block and chunk.
    ``fan_out``: entries of an index block, which forces more levels; ``meta_blocks``: by name.
    """

    def __init__(
        self,
        out,
        *,
        compression: str = "NONE",
        encoding: str = "NONE",
        tagged: bool = False,
        block_size: int = 65536,
        row_bloom: bool = False,
        fan_out: int | None = None,
        framed_zstd: bool = True,
        keys_per_chunk: int = 20_000,
        meta_blocks: dict[str, bytes] | None = None,
    ):
        self.out, self.kind, self.encoding, self.tagged, self.block_size = out, codec.CODECS[compression], encoding, tagged, block_size
        self.row_bloom, self.fan_out, self.framed_zstd, self.keys_per_chunk, self.meta_blocks = row_bloom, fan_out, framed_zstd, keys_per_chunk, meta_blocks or {}
        self.at, self.previous, self.index = 0, {}, []
        self.total = self.key_bytes = self.value_bytes = self.raw = self.most_tags = 0
        self.last: cells.Columns | None = None
        self.held, self.size, self.decoded, self.key = [], 0, 0, b""  # of the block under way: records, sizes, first key
        self.rows, self.n_rows, self.chunks, self.chunk_bytes = [], 0, [], 0

    def _put(self, what: str, data: bytes) -> tuple[int, int]:
        block = format_block(what, data, self.kind, self.previous.get(what, -1), framed=self.framed_zstd)
        self.previous[what] = at = self.at
        self.out.write(block)
        self.at += len(block)
        return at, len(block)

    def _flush(self) -> None:
        if not self.held:
            return
        fast = self.encoding == "FAST_DIFF"
        data = b"".join([b"\x00\x04", struct.pack(">I", self.decoded)] * fast + self.held)
        self.raw += len(data)
        self.index.append((*self._put("ENCODED_DATA" if fast else "DATA", data), self.key))
        self.held, self.size, self.decoded = [], 0, 0

    def _chunk(self, least: int) -> None:
        """Bloom chunks of the rows held, as long as there are ``least``."""
        held = sum(map(len, self.rows))
        if held < least:
            return
        rows = pa.concat_arrays(self.rows)
        while len(rows) >= least:
            part, rows = rows[: self.keys_per_chunk], rows[self.keys_per_chunk :]
            data = bloom.make_chunk(part, 5)
            self.chunks.append((*self._put("BLOOM_CHUNK", data), part[0].as_py()))
            self.chunk_bytes += len(data)
        self.rows = [rows] if len(rows) else []

    def add(self, c: cells.Columns) -> None:
        """The next cells, in order."""
        sizes = _checked(c)
        ends = np.cumsum(sum(sizes))
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
            self._add(cells.Columns(*(x[lo:hi] for x in c)), [x[lo:hi] for x in sizes])
            lo = hi

    def _add(self, c: cells.Columns, sizes: list[np.ndarray]) -> None:
        n = len(c.row)
        lead = int(self.last is not None)  # the cell before stands in front
        both = cells.Columns(*(pa.concat_arrays([a, b]) for a, b in zip(self.last, c, strict=True))) if lead else c
        if not _in_order(both):
            raise ValueError("cells are not in order")
        row, family, qualifier, value, tags = sizes
        key = row + family + qualifier + 12
        self.total += n
        self.key_bytes += int(key.sum())
        self.value_bytes += int(value.sum())
        self.most_tags = max(self.most_tags, int(tags.max()))
        if self.row_bloom:
            new = np.concatenate([[True] * (1 - lead), ~np.asarray(pc.equal(both.row[1:], both.row[:-1]))]).astype(bool)
            self.n_rows += int(new.sum())
            self.rows.append(c.row.filter(pa.array(new)))
            self._chunk(self.keys_per_chunk)
        grown = np.cumsum(key + value + tags + 9)
        starts, ends, before = [] if self.held else [0], [], -self.size
        while (end := int(np.searchsorted(grown, before + self.block_size, "left")) + 1) <= n:
            end = max(end, ends[-1] + 1 if ends else 1)
            ends.append(end)
            before = int(grown[end - 1])
            if end == n:
                break
            starts.append(end)
        if self.encoding == "FAST_DIFF":
            first = np.zeros(n + lead, bool)
            first[np.array(starts, np.int64) + lead] = True
            records = cells.fast_diff_records(both, first, self.tagged)[lead:]
        else:
            records = cells.plain_records(c, self.tagged)
        data, places, long = cells.bytes_of(records)
        places = [*places.tolist(), int(places[-1] + long[-1])]
        decoded = np.concatenate([[0], np.cumsum(21 + row + family + qualifier + value + ((2 + tags) if self.tagged else 0))])
        lo = 0
        for hi in [*ends, n]:
            if hi == lo:
                continue
            if not self.held:
                self.key = cells.key_of(_row(c, lo))
            self.held.append(data[places[lo] : places[hi]].tobytes())
            self.size += int(grown[hi - 1] - (grown[lo - 1] if lo else 0))
            self.decoded += int(decoded[hi] - decoded[lo])
            if self.size >= self.block_size:
                self._flush()
            lo = hi
        self.last = cells.Columns(*(x[-1:] for x in c))

    def close(self) -> None:
        """The end of the file; the stream is left open."""
        self._flush()
        index = self.index
        first_data, last_data = (index[0][0], index[-1][0]) if index else (0, 0)
        meta = None
        if self.row_bloom:
            self._chunk(1)
            meta = bloom.BloomMeta(self.chunk_bytes, 5, 1, self.n_rows, self.n_rows, len(self.chunks), "", self.chunks)
        meta_index = []
        for name, data in sorted(self.meta_blocks.items()):
            at, n = self._put("META", data)
            meta_index.append((at, n, name.encode()))
        levels, entries, level_kind = 1, index, "LEAF_INDEX"
        while self.fan_out and len(entries) > self.fan_out:
            above = []
            for i in range(0, len(entries), self.fan_out):
                part = entries[i : i + self.fan_out]
                at, n = self._put(level_kind, _non_root(part))
                above.append((at, n, part[0][2]))
            entries, levels, level_kind = above, levels + 1, "INTERMEDIATE_INDEX"
        load = self.at
        root = format_entries(entries)
        if levels > 1:
            root += struct.pack(">qii", index[len(index) // 2][0], index[len(index) // 2][1], 0)
        self._put("ROOT_INDEX", root)
        self._put("ROOT_INDEX", format_entries(meta_index))
        info = {
            "hfile.AVG_KEY_LEN": struct.pack(">i", self.key_bytes // self.total if self.total else 0),
            "hfile.AVG_VALUE_LEN": struct.pack(">i", self.value_bytes // self.total if self.total else 0),
            "hfile.LASTKEY": cells.key_of(_row(self.last, 0)) if self.last is not None else b"",
            "MAX_MEMSTORE_TS_KEY": struct.pack(">q", 0),
            "KEY_VALUE_VERSION": struct.pack(">i", 1),
            "DATA_BLOCK_ENCODING": self.encoding.encode(),
        }
        if self.tagged:
            info["hfile.MAX_TAGS_LEN"] = struct.pack(">i", max(1, self.most_tags))
        if self.row_bloom:
            info["BLOOM_FILTER_TYPE"] = b"ROW"
        info_at = self.at
        message = encode_message([(1, encode_message([(1, k), (2, v)])) for k, v in sorted(info.items())])
        self._put("FILE_INFO", b"PBUF" + write_varint(len(message)) + message)
        if meta is not None:
            self._put("GENERAL_BLOOM_META", bloom.format_meta(meta, format_entries))
        fields = [info_at, load, len(root), self.raw, len(entries), len(meta_index), self.total, levels, first_data, last_data]
        message = encode_message([*enumerate(fields, 1), (11, _COMPARATOR), (12, self.kind)])
        tail = MAGICS["TRAILER"] + write_varint(len(message)) + message
        self.out.write(tail + bytes(TRAILER_SIZE - 4 - len(tail)) + (3 | 3 << 24).to_bytes(4, "big"))


def write_cells(sorted_cells: Iterable[cells.Cell], **options) -> bytes:
    """The bytes of a file; options as of :class:`FileWriter`."""
    out = io.BytesIO()
    writer = FileWriter(out, **options)
    for some in batched(sorted_cells, 8192):
        writer.add(cells.columns_of(some))
    writer.close()
    return out.getvalue()
