"""What must not grow with the size of a file."""

import tracemalloc

import pyarrow as pa
import pytest

from cellstrata.format import storage
from cellstrata.format.cells import Cell, columns_of, format_fast_diff, format_plain
from cellstrata.format.reader import CellFile
from cellstrata.format.writer import FileWriter, write_cells


class Counted:
    """A stream that only counts."""

    size = 0

    def write(self, data):
        self.size += len(data)


def batches(n, values):
    for lo in range(0, n, 5000):
        yield columns_of([Cell(b"%010d" % (i // 3), b"o", (b"priority", b"status", b"total")[i % 3], i // 3 % 1000, 4, values(i)) for i in range(lo, lo + 5000)])


@pytest.mark.parametrize("options", [{"meta_blocks": {"note": b"meta"}}, {"encoding": "FAST_DIFF", "row_bloom": True}], ids=["plain", "snapshot"])
def test_a_file_is_written_as_its_cells_come(options):
    write_cells([Cell(b"a", b"f", b"q", 1, 4, b"")], **options)  # what is loaded and made once
    out = Counted()
    file = FileWriter(out, **options)
    most = 0
    tracemalloc.start()
    try:
        for c in batches(300_000, lambda i: b"%050d" % (i * 7919)):
            tracemalloc.reset_peak()
            file.add(c)
            most = max(most, tracemalloc.get_traced_memory()[1])
        before = out.size
        file.close()
    finally:
        tracemalloc.stop()
    assert file.total == 300_000 and out.size > 15 << 20
    assert before > 0.99 * out.size
    assert most + pa.total_allocated_bytes() < 12 << 20


def test_a_failed_file_leaves_nothing(tmp_path):
    with pytest.raises(ValueError, match="order"), storage.writing(str(tmp_path / "x")) as f:
        file = FileWriter(f)
        file.add(columns_of([Cell(b"b", b"f", b"q", 1, 4, b"")]))
        file.add(columns_of([Cell(b"a", b"f", b"q", 1, 4, b"")]))
    assert list(tmp_path.iterdir()) == []


def test_cells_come_in_pieces():
    """Blocks and their cells are the same wherever the batches end."""
    cells = [Cell(b"%05d" % (i // 2), b"f", b"pq"[i % 2 : i % 2 + 1], i % 5, 4, b"v" * (i % 9), b"t" * (i % 3)) for i in range(700)]
    for encoding, block in (("FAST_DIFF", lambda part: b"\x00\x04" + format_fast_diff(part, True)), ("NONE", lambda part: format_plain(part, True))):
        want = write_cells(cells, tagged=True, encoding=encoding, block_size=999, row_bloom=True, keys_per_chunk=50)
        read = CellFile(storage.InMemory(want))
        places = [cells.index(next(read.block_cells(o))) for o, _, _ in read.data_blocks()] + [len(cells)]
        assert [read._block(o) for o, _, _ in read.data_blocks()] == [block(cells[a:b])[2 * (encoding == "FAST_DIFF") :] for a, b in zip(places, places[1:], strict=False)]
        for step in (1, 7, 300):
            got = bytearray()
            stream = type("S", (), {"write": staticmethod(got.extend)})
            file = FileWriter(stream, tagged=True, encoding=encoding, block_size=999, row_bloom=True, keys_per_chunk=50)
            for lo in range(0, len(cells), step):
                file.add(columns_of(cells[lo : lo + step]))
            file.close()
            again = CellFile(storage.InMemory(bytes(got)))
            assert list(again.scan()) == cells and len(again.bloom.chunks) == 7
            assert [read._block(o) for o, _, _ in read.data_blocks()] == [again._block(o) for o, _, _ in again.data_blocks()]


def test_many_rows_are_asked_of_a_filter_at_once():
    """Each chunk is read once, whatever the number of rows, and the answers are those for single rows."""
    rows = [b"%04d" % i for i in range(900)]
    held = storage.InMemory(write_cells([Cell(r, b"f", b"q", 1, 4, b"") for r in rows], row_bloom=True, keys_per_chunk=300))
    file = CellFile(held)
    asked = rows + [b"x" + r for r in rows] + [r[:-1] + b"y" + r[-1:] for r in rows] + [b"", b"0"]
    one_by_one = [file.may_contain(r) for r in asked]
    reads, read_at = [], held.read_at
    held.read_at = lambda *a: reads.append(a) or read_at(*a)
    got = file.may_contain_all(asked)
    assert got.tolist() == one_by_one and all(got[:900]) and got[900:].sum() < 90
    assert len(reads) == 2 * 3  # header and body of each
