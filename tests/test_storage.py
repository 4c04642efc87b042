"""Remote storage by a filesystem of a scheme of its own: the window, listing, what is not there, request logs, added codecs."""

import logging
import os
import zlib

import pyarrow.fs as pafs
import pytest

from cellstrata import cli
from cellstrata.format import codec, storage
from cellstrata.format.cells import Cell
from cellstrata.format.errors import FormatError
from cellstrata.format.manifest import Description, Manifest, Region, StoreFile, read_manifest, write_manifest
from cellstrata.format.reader import CellFile
from cellstrata.format.writer import write_cells
from cellstrata.sources.cellfiles import Bounds, Split, _Reader, plan, read_blocks


@pytest.fixture
def remote(tmp_path, monkeypatch):
    """Paths of ``shelf://`` lie in a folder, but are read as any remote object is."""
    monkeypatch.setattr(storage, "_schemes", {})
    fs = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    storage.register_scheme("shelf", lambda path: (fs, path.removeprefix("shelf://")))
    return tmp_path


def cells(n=400, size=300):
    return [Cell(b"r%05d" % i, b"f", b"q", 1, 4, bytes([i % 256]) * size) for i in range(n)]


def test_reads_go_through_a_window(remote, monkeypatch, caplog):
    monkeypatch.setattr(storage, "WINDOW", 20_000)
    storage.write_file("shelf://a/b", bytes(range(256)) * 400)
    with caplog.at_level(logging.DEBUG, "cellstrata.storage"), storage.RandomAccess("shelf://a/b") as f:
        assert f.size == 102_400
        assert f.read_at(5, 10) == bytes(range(5, 15)) and f.read_at(1000, 4) == bytes([232, 233, 234, 235])
        assert f.read_at(19_000, 1000)[:1] == bytes([19_000 % 256])
        assert len(caplog.records) == 1  # one request for all three
        assert len(f.read_at(19_000, 5000)) == 5000  # past the window: fetched anew
        assert len(f.read_at(0, 60_000)) == 60_000  # more than a window
        assert f.read_at(102_390, 10) == bytes(range(246, 256))  # cut at the end
        assert len(caplog.records) == 4 and "bytes at 102390 of shelf://a/b" in caplog.records[-1].getMessage()
        for at, n in ((-1, 4), (102_399, 2), (0, -1)):
            with pytest.raises(FormatError):
                f.read_at(at, n)


def test_local_files_are_read_as_asked(tmp_path, caplog):
    storage.write_file(str(tmp_path / "x"), b"abcdef")
    with caplog.at_level(logging.DEBUG, "cellstrata.storage"), storage.RandomAccess(str(tmp_path / "x")) as f:
        assert f.read_at(1, 2) == b"bc" and f.read_at(1, 2) == b"bc" and len(caplog.records) == 2


def test_listing(remote):
    for name in ("top/b", "top/a", "top/sub/c", "top/.hidden", "top/_temporary/d", "top/half.tmp"):
        storage.write_file(f"shelf://{name}", b"x" * len(name))
    assert storage.list_files("shelf://top") == ["shelf://top/a", "shelf://top/b", "shelf://top/sub/c"]
    assert storage.list_sizes("shelf://top/sub/c") == [("shelf://top/sub/c", 9)]
    assert storage.list_dir("shelf://top") == [".hidden", "a", "b", "half.tmp"] and storage.list_dir("shelf://nowhere") == []
    assert storage.read_file("shelf://nowhere") is None and storage.read_file("shelf://top") is None
    with pytest.raises(OSError):
        storage.RandomAccess("shelf://nowhere")


def test_cell_files_of_remote_storage(remote):
    expected = cells()
    storage.write_file("shelf://s/one", write_cells(expected, compression="ZSTD", block_size=2000, fan_out=4, row_bloom=True))
    storage.write_file("shelf://s/two", write_cells(expected[:9], encoding="FAST_DIFF"))
    with storage.RandomAccess("shelf://s/one") as f:
        assert list(CellFile(f).scan()) == expected
    reader = _Reader({"path": "shelf://s", "splitBytes": "1000"})
    parts = reader.partitions()
    assert len(parts) > 3 and {p.path for p in parts} == {"shelf://s/one", "shelf://s/two"}
    rows = [(r, s) for p in parts for b in reader.read(p) for r, s in zip(b.column(0).to_pylist(), b.column(7).to_pylist(), strict=True)]
    assert sorted(rows) == sorted([(c.row, "shelf://s/one") for c in expected] + [(c.row, "shelf://s/two") for c in expected[:9]])
    bounds = Bounds(b"r00100", b"r00110")
    found = plan("shelf://s/one", bounds)
    got = [r for b in read_blocks("shelf://s/one", 0, found.first, [o for o, _ in found.blocks], found.layout, bounds) for r in b.column(0).to_pylist()]
    assert got == [b"r%05d" % i for i in range(100, 110)]


def test_manifests_of_remote_storage(remote):
    region = Region(5, b"shop", b"orders", b"", b"m")
    region.families.append((b"a", [StoreFile("f1", 3)]))
    for by_region in (False, True):
        folder = f"shelf://snap{by_region}"
        write_manifest(folder, Manifest(Description("s", "shop:orders", 5, "FLUSH", 2, "me"), None, [region]), by_region)
        assert read_manifest(folder).regions == [region]
    with pytest.raises(FormatError):
        read_manifest("shelf://nothing")


def test_added_codecs(monkeypatch):
    for name in ("CODECS", "NAMES", "_more"):
        monkeypatch.setattr(codec, name, dict(getattr(codec, name)))
    codec.register(90, "PLAINZ", lambda data, size: zlib.decompress(data), zlib.compress)
    expected = cells(50)
    assert list(CellFile(storage.InMemory(write_cells(expected, compression="PLAINZ", block_size=900))).scan()) == expected
    with pytest.raises(ValueError):
        codec.register(90, "OTHER", None, None)
    with pytest.raises(FormatError):
        codec.decompress(91, b"", 0)


def test_verbose_logs_requests(tmp_path, capsys, monkeypatch):
    """As a worker does; a verbose command passes the option on."""
    monkeypatch.setattr(storage.log, "handlers", [])
    path = os.fspath(tmp_path / "file")
    storage.write_file(path, write_cells(cells(5)))
    split = Split(path, 0, 0, 1 << 30)
    quiet, told = _Reader({"path": path}), _Reader({"path": path, "verbose": "true"})
    assert sum(b.num_rows for b in quiet.read(split)) == 5 and not capsys.readouterr().err
    try:
        assert sum(b.num_rows for b in told.read(split)) == 5
    finally:
        storage.log.setLevel(logging.NOTSET)
    assert f"bytes at 0 of {path}" in capsys.readouterr().err


def test_file_command(spark, tmp_path, capsys):
    path = os.fspath(tmp_path / "file")
    storage.write_file(path, write_cells(cells(5), row_bloom=True, meta_blocks={"note": b"x"}))
    cli.main(["--verbose", "file", path, "--dump"])
    said = capsys.readouterr().out
    storage.log.handlers.clear()
    storage.log.setLevel(logging.NOTSET)
    assert "name=note" in said and "hash_count=5" in said and "entry_count=5" in said and "n_cells=5" in said
    assert [f"r0000{i}/f:q/1/Put" in said for i in range(5)] == [True] * 5
