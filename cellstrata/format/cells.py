"""Cells in blocks: plain records, and the delta encoding of fast-diff blocks.

A key is row length u16, row, family length u8, family, qualifier, timestamp u64, type u8.
A plain record is key length u32, value length u32, key, value, tags if the file has them
(length u16 first), and a memstore timestamp.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cellstrata.format.errors import FormatError
from cellstrata.format.wire import read_compact, read_vint, write_compact, write_vint


class Cell(NamedTuple):
    row: bytes
    family: bytes
    qualifier: bytes
    ts: int  # unsigned
    type: int
    value: bytes
    tags: bytes = b""


def key_of(c: Cell) -> bytes:
    return struct.pack(">H", len(c.row)) + c.row + bytes([len(c.family)]) + c.family + c.qualifier + struct.pack(">QB", c.ts, c.type)


def split_key(key: bytes) -> tuple[bytes, bytes, bytes, int, int]:
    if len(key) < 12:
        raise FormatError(f"key of {len(key)} bytes")
    row_end = 2 + int.from_bytes(key[:2], "big")
    tail = len(key) - 9
    if row_end >= tail:
        raise FormatError("row past its key")
    family_end = row_end + 1 + key[row_end]
    if family_end > tail:
        raise FormatError("family past its key")
    ts, kind = struct.unpack_from(">QB", key, tail)
    return key[2:row_end], key[row_end + 1 : family_end], key[family_end:tail], ts, kind


def sort_key(c: Cell):
    return c.row, c.family, c.qualifier, -c.ts, -c.type


def raw_compare_key(key: bytes) -> tuple[bytes, bytes]:
    """Orders serialized keys, or the row-only beginnings of keys, for a raw seek."""
    end = min(len(key), 2 + int.from_bytes(key[:2], "big"))
    return key[2:end], key[end:]


def parse_plain(b: bytes, tagged: bool) -> Iterator[Cell]:
    at, end = 0, len(b)
    while at < end:
        if at + 8 > end:
            raise FormatError("cell cut short")
        key_size, value_size = struct.unpack_from(">II", b, at)
        at += 8
        if at + key_size + value_size > end:
            raise FormatError("cell past its block")
        parts = split_key(b[at : at + key_size])
        at += key_size
        value = b[at : at + value_size]
        at += value_size
        tags = b""
        if tagged:
            if at + 2 > end:
                raise FormatError("tags cut short")
            size = int.from_bytes(b[at : at + 2], "big")
            at += 2
            if at + size > end:
                raise FormatError("tags past their block")
            tags = b[at : at + size]
            at += size
        if at < end:
            _, at = read_vint(b, at)
        yield Cell(*parts, value, tags)


class Columns(NamedTuple):
    """The cells of a block as Arrow arrays."""

    row: pa.Array
    family: pa.Array
    qualifier: pa.Array
    ts: pa.Array  # signed, as Spark has it
    type: pa.Array
    value: pa.Array
    tags: pa.Array


def _cut(buf: np.ndarray, s: np.ndarray, size: np.ndarray) -> pa.Array:
    """buf[s : s + size] of every cell, gathered end to end."""
    ends = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.arange(ends[-1]) + np.repeat(s - ends[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def columns_of(cells: list[Cell]) -> Columns:
    binary = lambda i: pa.array([c[i] for c in cells], pa.binary())
    stamps = np.array([c.ts for c in cells], np.uint64).astype(np.int64)
    return Columns(binary(0), binary(1), binary(2), pa.array(stamps), pa.array([c.type for c in cells], pa.int32()), binary(5), binary(6))


def bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary array's data, and where each element begins and its size."""
    places = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), places[:-1], np.diff(places)


def _fixed(a: np.ndarray) -> pa.Array:
    """Records of one width as binary elements."""
    places = np.arange(len(a) + 1, dtype=np.int32) * a.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(places), pa.py_buffer(a.tobytes())])


def _end_to_end(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))


def plain_columns(b: bytes, tagged: bool, values: bool = True) -> Columns:
    """A plain block's cells: one look at each record's lengths, then all fields at once."""
    at, end, sizes = 0, len(b), struct.Struct(">II").unpack_from
    keys, key_sizes, value_sizes, tag_sizes = [], [], [], []
    while at < end:
        if at + 8 > end:
            raise FormatError("cell cut short")
        k, v = sizes(b, at)
        keys.append(at + 8)
        key_sizes.append(k)
        value_sizes.append(v)
        at += 8 + k + v
        if at > end:
            raise FormatError("cell past its block")
        if tagged:
            if at + 2 > end:
                raise FormatError("tags cut short")
            n = b[at] << 8 | b[at + 1]
            at += 2 + n
            if at > end:
                raise FormatError("tags past their block")
            tag_sizes.append(n)
        if at < end:
            lead = b[at]
            if lead < 128 or lead >= 144:  # a number of one byte
                at += 1
            else:
                _, at = read_vint(b, at)
    buf = np.frombuffer(b, np.uint8)
    key, size, value = (np.array(x, dtype=np.int64) for x in (keys, key_sizes, value_sizes))
    if (size < 12).any():
        raise FormatError(f"key of {size.min()} bytes")
    row_size = buf[key].astype(np.int64) << 8 | buf[key + 1]
    tail, row_end = key + size - 9, key + 2 + row_size
    if (row_end >= tail).any():
        raise FormatError("row past its key")
    family_size = buf[row_end].astype(np.int64)
    family_end = row_end + 1 + family_size
    if (family_end > tail).any():
        raise FormatError("family past its key")
    stamps = buf[tail[:, None] + np.arange(8)].copy().view(">i8").ravel().astype(np.int64)
    none = np.zeros(len(key), np.int64)
    return Columns(
        _cut(buf, key + 2, row_size), _cut(buf, row_end + 1, family_size), _cut(buf, family_end, tail - family_end), pa.array(stamps), pa.array(buf[tail + 8].astype(np.int32)),
        _cut(buf, key + size, value if values else none), _cut(buf, key + size + value + 2, np.array(tag_sizes, dtype=np.int64)) if tagged else _cut(buf, none, none),
    )


def format_plain(cells: Iterable[Cell], tagged: bool) -> bytes:
    out = []
    sizes, ends, zero = struct.Struct(">IIH"), struct.Struct(">QB"), write_vint(0)
    for c in cells:
        row, family, qualifier, ts, kind, value, tags = c
        out += (sizes.pack(12 + len(row) + len(family) + len(qualifier), len(value), len(row)), row, bytes((len(family),)), family, qualifier, ends.pack(ts, kind), value)
        if tagged:
            out += (struct.pack(">H", len(tags)), tags)
        out.append(zero)
    return b"".join(out)


_HEAD = np.dtype([("key", ">u4"), ("value", ">u4"), ("row", ">u2")])
_TAIL = np.dtype([("ts", ">i8"), ("type", "u1")])


def plain_records(c: Columns, tagged: bool) -> pa.Array:
    """The record of each cell of a plain block, all at once; as :func:`format_plain` has them."""
    row, family, qualifier, value, tags = (bytes_of(x)[2] for x in (c.row, c.family, c.qualifier, c.value, c.tags))
    head, tail = np.empty(len(row), _HEAD), np.empty(len(row), _TAIL)
    head["key"], head["value"], head["row"] = 12 + row + family + qualifier, value, row
    tail["ts"], tail["type"] = c.ts.to_numpy(), c.type.to_numpy()
    parts = [_fixed(head), c.row, _fixed(family.astype(np.uint8)), c.family, c.qualifier, _fixed(tail), c.value]
    if tagged:
        parts += [_fixed(tags.astype(">u2")), c.tags]
    return _end_to_end(*parts, _fixed(np.zeros(len(row), np.uint8)))


_SAME_KEY_SIZE, _SAME_VALUE_SIZE, _SAME_TYPE, _SAME_VALUE = 8, 16, 32, 64


def _fast_diff(b: bytes, tagged: bool) -> tuple[list, list, list, list, list, list, list]:
    """Rows, families, qualifiers, stamps, types, values and tags of an encoded block.

    Each cell is told against the one before: what of its key, stamp, type and value is the same. A slice past the
    end comes out short; whether one did is looked at where a length is taken from it, and at each cell's end.
    """
    rows, families, qualifiers, stamps, kinds, values, tags = out = [], [], [], [], [], [], []
    n = len(b)
    if n < 4:
        raise FormatError("encoded block cut short")
    at, first = 4, True  # the decoded size comes first
    head, row, family, qualifier, stamp, kind, value, own_tags = b"", b"", b"", b"", bytes(8), 0, b"", b""
    key_size = value_size = family_end = 0
    while at < n:
        flag = b[at]
        at += 1
        if not flag & _SAME_KEY_SIZE:
            key_size, at = read_compact(b, at)
        if not flag & _SAME_VALUE_SIZE:
            value_size, at = read_compact(b, at)
        common, at = read_compact(b, at)
        size = key_size - 9  # of row length to qualifier
        if size < 3 or common > size or (first and common):
            raise FormatError("encoded key sizes do not fit")
        if not first and common >= family_end:  # only the qualifier differs
            rest = size - common
            head = head[:common] + b[at : at + rest]
            at += rest
            qualifier = head[family_end:]
        else:
            if first or common >= 2 + len(row):
                rest = size - common
                head = head[:common] + b[at : at + rest]
                at += rest
            else:  # the row differs: it comes to its end, then the qualifier, as the family stays
                front = head[:common]
                if common < 2:
                    front += b[at : at + 2 - common]
                    at += 2 - common
                if at > n:
                    break
                end = 2 + (front[0] << 8 | front[1])
                if end < len(front):
                    raise FormatError("encoded key sizes do not fit")
                rest = end - len(front)
                front += b[at : at + rest]
                at += rest
                rest = size - end - 1 - len(family)
                if rest < 0:
                    raise FormatError("encoded key sizes do not fit")
                head = front + head[family_end - len(family) - 1 : family_end] + b[at : at + rest]
                at += rest
            if at > n:
                break
            row, family, qualifier, _, _ = split_key(head + bytes(9))
            family_end = 3 + len(row) + len(family)
        same = flag & 7
        stamp = stamp[:same] + b[at : at + 8 - same]
        at += 8 - same
        if first or not flag & _SAME_TYPE:
            if at >= n:
                raise FormatError("encoded cell past its block")
            kind = b[at]
            at += 1
        if first or not flag & _SAME_VALUE:
            value = b[at : at + value_size]
            at += value_size
        elif len(value) != value_size:
            raise FormatError("encoded value sizes do not fit")
        if tagged:
            size, at = read_compact(b, at)
            own_tags = b[at : at + size]
            at += size
        if at > n:
            break
        if at < n:
            lead = b[at]
            if lead < 128 or lead >= 144:  # a number of one byte
                at += 1
            else:
                _, at = read_vint(b, at)
        first = False
        rows.append(row)
        families.append(family)
        qualifiers.append(qualifier)
        stamps.append(stamp)
        kinds.append(kind)
        values.append(value)
        tags.append(own_tags)
    if at > n:
        raise FormatError("encoded cell past its block")
    return out


def fast_diff_columns(b: bytes, tagged: bool, values: bool = True) -> Columns:
    rows, families, qualifiers, stamps, kinds, told, tags = _fast_diff(b, tagged)
    binary = lambda x: pa.array(x, pa.binary())
    stamp = np.frombuffer(b"".join(stamps), ">i8").astype(np.int64)
    empty = [b""] * len(rows)
    return Columns(binary(rows), binary(families), binary(qualifiers), pa.array(stamp), pa.array(kinds, pa.int32()), binary(told if values else empty), binary(tags))


def parse_fast_diff(b: bytes, tagged: bool) -> Iterator[Cell]:
    rows, families, qualifiers, stamps, *rest = _fast_diff(b, tagged)
    for cell in zip(rows, families, qualifiers, (int.from_bytes(s, "big") for s in stamps), *rest, strict=True):
        yield Cell(*cell)


def format_fast_diff(cells: list[Cell], tagged: bool) -> bytes:
    decoded = sum(21 + len(c.row) + len(c.family) + len(c.qualifier) + len(c.value) + (2 + len(c.tags) if tagged else 0) for c in cells)
    out = bytearray(struct.pack(">I", decoded))
    last: Cell | None = None
    head = b""
    for c in cells:
        now = key_of(c)[:-9]
        flag, common = 0, 0
        stamp = struct.pack(">Q", c.ts)
        if last is not None:
            while common < min(len(now), len(head)) and now[common] == head[common]:
                common += 1
            if len(now) == len(head):
                flag |= _SAME_KEY_SIZE
            if len(c.value) == len(last.value):
                flag |= _SAME_VALUE_SIZE
            if c.type == last.type:
                flag |= _SAME_TYPE
            if c.value == last.value:
                flag |= _SAME_VALUE
            old = struct.pack(">Q", last.ts)
            same = 0
            while same < 7 and stamp[same] == old[same]:
                same += 1
            flag |= same
            if c.family != last.family:
                raise FormatError("one family a file")
        row_end = 2 + len(c.row)
        out.append(flag)
        if not flag & _SAME_KEY_SIZE:
            out += write_compact(len(now) + 9)
        if not flag & _SAME_VALUE_SIZE:
            out += write_compact(len(c.value))
        if last is not None and common < row_end:
            # a prefix that ends in the row leaves the family out
            out += write_compact(common) + now[common:row_end] + c.qualifier
        else:
            out += write_compact(common) + now[common:]
        out += stamp[flag & 7 :]
        if not flag & _SAME_TYPE:
            out.append(c.type)
        if not flag & _SAME_VALUE:
            out += c.value
        if tagged:
            out += write_compact(len(c.tags)) + c.tags
        out += write_vint(0)
        last, head = c, now
    return bytes(out)


def _compact(numbers: np.ndarray, told: np.ndarray | None = None) -> pa.Array:
    """Compact numbers; nothing where one is not told."""
    steps = 7 * np.arange(5)
    more = numbers[:, None] >> steps
    size = 1 + (more[:, 1:] > 0).sum(axis=1)
    data = (more & 0x7F | np.where(np.arange(5) < size[:, None] - 1, 0x80, 0)).astype(np.uint8)
    return _cut(data.ravel(), 5 * np.arange(len(numbers)), size if told is None else np.where(told, size, 0))


def _common(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes that each element shares with the beginning of the one before; none with ``first``."""
    out = np.zeros(len(starts), np.int64)
    at = np.flatnonzero(~first)
    most = np.minimum(sizes[at], sizes[at - 1])
    k = 0
    while len(at):
        same = most > k
        at, most = at[same], most[same]
        same = data[starts[at] + k] == data[starts[at - 1] + k]
        at, most = at[same], most[same]
        k += 1
        out[at] = k
    return out


def fast_diff_records(c: Columns, first: np.ndarray, tagged: bool) -> pa.Array:
    """What a fast-diff block has of each cell, all at once, as :func:`format_fast_diff`; ``first``: which begin a block."""
    n, head = len(first), first | (np.arange(len(first)) == 0)
    before = np.maximum(np.arange(n) - 1, 0)
    row, family, qualifier = (bytes_of(x)[2] for x in (c.row, c.family, c.qualifier))
    if (~head[1:] & ~np.asarray(pc.equal(c.family[1:], c.family[:-1]))).any():
        raise FormatError("one family a file")
    now = _end_to_end(_fixed(row.astype(">u2")), c.row, _fixed(family.astype(np.uint8)), c.family, c.qualifier)
    data, starts, sizes = bytes_of(now)
    common = _common(data, starts, sizes, head)
    value, value_at, value_size = bytes_of(c.value)
    kind = c.type.to_numpy()
    stamp = c.ts.to_numpy().view(np.uint64)
    differs = stamp ^ stamp[before]
    same_stamp = sum((differs >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
    same_key, same_size, same_kind = (~head & (x == x[before]) for x in (sizes, value_size, kind))
    same_value = np.concatenate([[False], np.asarray(pc.equal(c.value[1:], c.value[:-1]))])[:n] & ~head
    same_stamp[head] = 0
    flag = same_stamp + _SAME_KEY_SIZE * same_key + _SAME_VALUE_SIZE * same_size + _SAME_TYPE * same_kind + _SAME_VALUE * same_value
    in_row = ~head & (common < 2 + row)  # a prefix that ends in the row leaves the family out
    parts = [
        _fixed(flag.astype(np.uint8)),
        _compact(sizes + 9, ~same_key),
        _compact(value_size, ~same_size),
        _compact(common),
        _cut(data, starts + common, np.where(in_row, 2 + row, sizes) - common),
        _cut(data, starts + sizes - qualifier, np.where(in_row, qualifier, 0)),
        _cut(stamp.astype(">u8").view(np.uint8), 8 * np.arange(n) + same_stamp, 8 - same_stamp),
        _cut(kind.astype(np.uint8), np.arange(n), np.where(same_kind, 0, 1)),
        _cut(value, value_at, np.where(same_value, 0, value_size)),
    ]
    if tagged:
        parts += [_compact(bytes_of(c.tags)[2]), c.tags]
    return _end_to_end(*parts, _fixed(np.zeros(n, np.uint8)))
