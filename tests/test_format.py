"""The cell file format: round trips through the writer, known answers, and damaged files."""

import os
import re
import struct
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellstrata.format import bloom, checksum, codec, wire
from cellstrata.format.cells import Cell, fast_diff_columns, format_fast_diff, format_plain, key_of, parse_fast_diff, parse_plain, plain_columns, sort_key
from cellstrata.format.errors import FormatError
from cellstrata.format.reader import CellFile, row_prefix
from cellstrata.format.storage import InMemory, join_path, split_bucket
from cellstrata.format.writer import write_cells

#: A folder of files that other software wrote, each as a quoted byte string on its second line; the known bytes below are always read.
CORPUS = os.environ.get("CELLFILE_CORPUS")


def cell_lists(tagged):
    one = st.tuples(st.binary(min_size=1, max_size=12), st.binary(max_size=8), st.integers(0, 2**64 - 1) | st.integers(1, 5), st.sampled_from([4, 8, 12, 14]), st.binary(max_size=40), st.binary(max_size=9 if tagged else 0))
    return st.lists(one, max_size=60).map(lambda xs: sorted([Cell(r, b"cf", q, t, k, v, g) for r, q, t, k, v, g in xs], key=sort_key))


@settings(max_examples=120, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.data())
def test_round_trip(data):
    tagged = data.draw(st.booleans())
    cells = data.draw(cell_lists(tagged))
    options = dict(
        compression=data.draw(st.sampled_from(["NONE", "GZ", "SNAPPY", "ZSTD"])),
        encoding=data.draw(st.sampled_from(["NONE", "FAST_DIFF"])),
        block_size=data.draw(st.sampled_from([1, 64, 300, 65536])),
        row_bloom=data.draw(st.booleans()),
        fan_out=data.draw(st.sampled_from([None, 2, 3])),
        framed_zstd=data.draw(st.booleans()),
    )
    file = CellFile(InMemory(write_cells(cells, tagged=tagged, **options)))
    assert file.trailer.entry_count == len(cells)
    assert list(file.scan()) == cells
    assert (file.bloom is not None) == options["row_bloom"]
    assert all(file.may_contain(c.row) for c in cells)
    if len(cells) > 6 and options["fan_out"] == 2 and options["block_size"] == 1:
        assert file.trailer.data_index_levels >= 2


@settings(max_examples=80, deadline=None)
@given(cell_lists(False), st.binary(max_size=12))
def test_seek(cells, row):
    file = CellFile(InMemory(write_cells(cells, block_size=64)))
    raw = sorted(cells, key=lambda c: c.row)
    assert [c.row for c in file.scan_from(row_prefix(row))] == [c.row for c in raw if c.row >= row]


def test_seek_with_a_full_key_takes_timestamps_as_rising():
    cells = [Cell(f"row-{i:03d}".encode(), b"cf", b"q", 1700000000000, 4, b"v") for i in range(100)]
    file = CellFile(InMemory(write_cells(cells, block_size=256)))
    after = Cell(b"row-042", b"cf", b"q", 2**64 - 1, 4, b"")
    assert next(file.scan_from(key_of(after))).row == b"row-043"
    assert next(file.scan_from(key_of(cells[42]))).row == b"row-042"
    assert list(file.scan_from(row_prefix(b"zzz"))) == []


def test_golden_ten_cells():
    cells = [Cell(f"row-{i:02d}".encode(), b"cf", b"q", 1700000000000, 4, f"val-{i:02d}".encode()) for i in range(10)]
    file = CellFile(InMemory(write_cells(cells, row_bloom=True)))
    assert file.trailer.entry_count == 10 and file.trailer.data_index_levels == 1
    assert int.from_bytes(file.file_info["hfile.AVG_KEY_LEN"], "big") == 21
    assert int.from_bytes(file.file_info["hfile.AVG_VALUE_LEN"], "big") == 6
    assert not file.may_contain(b"aaa")


@settings(max_examples=60, deadline=None)
@given(cell_lists(True))
def test_block_layouts(cells):
    assert list(parse_plain(format_plain(cells, True), True)) == cells
    assert list(parse_fast_diff(format_fast_diff(cells, True), True)) == cells


def told(columns):
    """Cells of a block's arrays."""
    return [Cell(*c[:3], c[3] % (1 << 64), *c[4:]) for c in zip(*(x.to_pylist() for x in columns), strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.booleans(), st.data())
def test_columns_equal_cells(tagged, data):
    cells = data.draw(cell_lists(tagged))
    assert told(plain_columns(format_plain(cells, tagged), tagged)) == cells
    assert told(fast_diff_columns(format_fast_diff(cells, tagged), tagged)) == cells
    assert [c.value for c in told(plain_columns(format_plain(cells, tagged), tagged, False))] == [b""] * len(cells)


@settings(max_examples=300, deadline=None)
@given(st.booleans(), st.integers(0, 10**9), st.integers(0, 255), st.integers(0, 40))
def test_columns_refuse_what_cells_refuse(tagged, at, byte, less):
    cells = [Cell(b"r%02d" % (i // 3), b"f", b"q%d" % (i % 3), 9 - i % 2, 4, b"v" * i, b"t" * (i % 4) if tagged else b"") for i in range(30)]
    data = bytearray(format_plain(cells, tagged))
    data[at % len(data)] = byte
    data = bytes(data[: len(data) - less])
    try:
        expected = list(parse_plain(data, tagged))
    except FormatError:
        with pytest.raises(FormatError):
            plain_columns(data, tagged)
    else:
        assert told(plain_columns(data, tagged)) == expected


@given(st.integers(-(2**63), 2**63 - 1))
def test_vint(n):
    b = wire.write_vint(n)
    assert wire.read_vint(b, 0) == (n, len(b))


@given(st.integers(0, 2**31 - 1))
def test_compact(n):
    b = wire.write_compact(n)
    assert wire.read_compact(b, 0) == (n, len(b))


def test_known_answers():
    assert checksum.crc32c(b"123456789") == 0xE3069283
    assert checksum.crc32c(b"") == 0
    long = bytes(range(256)) * 70
    state = 0xFFFFFFFF
    for byte in long:  # bit by bit
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
    assert checksum.crc32c(long) == state ^ 0xFFFFFFFF
    assert bloom.murmur2(b"", 0) == 0
    assert wire.read_vint(b"\x8f\x80", 0)[0] == 128 and wire.read_vint(b"\x90", 0)[0] == -112


@pytest.mark.parametrize("kind", ["GZ", "SNAPPY", "ZSTD", "NONE"])
def test_codecs(kind):
    data = os.urandom(1000) + bytes(5000)
    packed = codec.compress(codec.CODECS[kind], data)
    assert codec.decompress(codec.CODECS[kind], packed, len(data)) == data
    with pytest.raises(FormatError):
        codec.decompress(codec.CODECS[kind], packed[: len(packed) // 2], len(data))


def test_paths():
    assert split_bucket("gs://b/x/y") == ("b", "x/y") and split_bucket("gs:///x") is None and split_bucket("/x") is None
    assert join_path("gs://b/x", "y", "z") == "gs://b/x/y/z" and join_path("/a/b/", "../c") == "/a/c"


def test_damage_is_told():
    data = bytearray(write_cells([Cell(b"r%02d" % i, b"f", b"q", 1, 4, b"v" * 50) for i in range(50)], block_size=500))
    data[60] ^= 1
    with pytest.raises(FormatError, match="checksum"):
        list(CellFile(InMemory(bytes(data))).scan())
    with pytest.raises(FormatError):
        CellFile(InMemory(bytes(data[:-100])))
    assert len(list(CellFile(InMemory(write_cells([])), True).scan())) == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 255), st.sampled_from(["NONE", "FAST_DIFF"]))
def test_damaged_bytes_raise_only_format_errors(at, byte, encoding):
    data = bytearray(write_cells([Cell(b"r%02d" % (i // 3), b"f", b"q%d" % (i % 3), 9 - i % 2, 4, b"v" * i) for i in range(30)], block_size=100, encoding=encoding, compression="GZ", fan_out=2, row_bloom=True))
    data[at % len(data)] = byte
    try:
        file = CellFile(InMemory(bytes(data)), verify=False)
        list(file.scan())
        file.may_contain(b"r01")
    except FormatError:
        pass


def _unquote(text: str) -> bytes:
    out = bytearray()
    simple = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, '"': 34, "'": 39}
    for m in re.finditer(r"\\x(..)|\\u(....)|\\U(.{8})|\\(.)|(.)", text, re.S):
        x, u, v, s, c = m.groups()
        out += bytes([int(x, 16)]) if x else chr(int(u or v, 16)).encode() if u or v else bytes([simple[s]]) if s else c.encode("utf-8")
    return bytes(out)


@pytest.mark.skipif(not CORPUS, reason="CELLFILE_CORPUS names no folder")
def test_corpus_of_real_files():
    """Whole files give as many cells as they declare, in order; damaged ones only a FormatError."""
    read = 0
    for path in sorted(Path(CORPUS).iterdir()):
        body = path.read_text(encoding="utf-8").split("\n")[1]
        data = _unquote(body[len('[]byte("') : -2])
        try:
            file = CellFile(InMemory(data))
            cells = list(file.scan())
        except FormatError:
            continue
        assert len(cells) == file.trailer.entry_count or file.trailer.entry_count == 0
        assert cells == sorted(cells, key=sort_key)
        assert all(file.may_contain(c.row) for c in cells)
        read += 1
    assert read >= 20


def test_known_bytes_of_a_plain_block():
    """A record spelled out: key and value lengths, key, value, memstore timestamp."""
    key = "0002 7231 01 66 71 0000000000000005 04"
    block = bytes.fromhex(f"00000010 00000002 {key} 7631 00  00000010 00000000 {key.replace('7231', '7232').replace('05 04', '05 08')} 8f80")
    cells = [Cell(b"r1", b"f", b"q", 5, 4, b"v1"), Cell(b"r2", b"f", b"q", 5, 8, b"")]
    assert list(parse_plain(block, False)) == told(plain_columns(block, False)) == cells
    tagged = bytes.fromhex(f"00000010 00000002 {key} 7631 0004 0002 0178 00")
    assert list(parse_plain(tagged, True)) == told(plain_columns(tagged, True)) == [Cell(b"r1", b"f", b"q", 5, 4, b"v1", b"\x00\x02\x01x")]


def test_known_bytes_of_an_encoded_block():
    """Three cells spelled out: the first in full; another row of the same family; another qualifier of that row."""
    first = "00 10 02 00  0002 7231 01 66 71  0000000000000005 04 7631 00"
    row = "7f 03  32 71  05 00"  # sizes, type, value and seven bytes of the stamp as before; the row's end, the qualifier
    qualifier = "3f 06  7a  07 7632 00"  # the value differs
    block = bytes.fromhex(f"00000054 {first} {row} {qualifier}")
    cells = [Cell(b"r1", b"f", b"q", 5, 4, b"v1"), Cell(b"r2", b"f", b"q", 5, 4, b"v1"), Cell(b"r2", b"f", b"z", 7, 4, b"v2")]
    assert list(parse_fast_diff(block, False)) == told(fast_diff_columns(block, False)) == cells
    for n in range(5, len(block) - 1):
        if n not in (4 + len(bytes.fromhex(first)), 4 + len(bytes.fromhex(first + row))) and n + 1 not in (4 + len(bytes.fromhex(first)), 4 + len(bytes.fromhex(first + row))):
            with pytest.raises(FormatError):
                list(parse_fast_diff(block[:n], False))


def test_big_endian_header():
    assert struct.pack(">H", 3) + b"abc" == row_prefix(b"abc")
