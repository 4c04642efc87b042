"""Sources and sink: files written by Spark and read back, pruning, errors, snapshots."""

import pytest
from pyspark.sql import functions as F

from cellstrata.format import storage
from cellstrata.format.errors import FormatError
from cellstrata.format.manifest import Description, Manifest, Region, StoreFile, read_manifest, write_manifest
from cellstrata.sources import cellfiles
from cellstrata.sources.cellfiles import Bounds, enable_pushdown, plan, read_files, register, seek_files
from cellstrata.sources.sink import write_store
from cellstrata.sources.snapshots import scan_snapshot, snapshot


def rows(spark, n=200):
    key = F.lpad(F.col("id").cast("string"), 5, "0").cast("binary")
    return spark.range(n).select(key.alias("row"), F.lit(b"cf").alias("family"), F.lit(b"q").alias("qualifier"), (F.col("id") % 7).alias("ts"), F.lit(4).alias("type"), key.alias("value"))


def keys(df):
    return sorted(bytes(r.row).decode() for r in df.select("row").collect())


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    made = write_store(rows(spark), folder, partitions=3, block_size=300, row_bloom=True, compression="GZ").collect()
    assert sum(m.n_cells for m in made) == 200 and len(made) == 3
    return folder


def test_load(spark, store):
    df = register(spark).read.format("cellfile").option("splitBytes", 500).load(store)
    assert keys(df) == [f"{i:05d}" for i in range(200)]
    assert df.rdd.getNumPartitions() > 3
    one = df.where(F.col("row") == F.lit(b"00007")).first()
    assert (bytes(one.value), one.ts, one.type, bytes(one.tags)) == (b"00007", 0, 4, b"")
    assert df.select("file", "seq").distinct().count() == 200


def test_bounds_prune_blocks(spark, store):
    df = register(spark).read.format("cellfile").options(startKey="00050", endKey="00060").load(store)
    assert keys(df) == [f"{i:05d}" for i in range(50, 60)]
    file = storage.list_files(store)[0]
    whole, part = plan(file, Bounds()), plan(file, Bounds(b"00010", b"00011"))
    assert 0 < len(part.blocks) < len(whole.blocks)
    runs = whole.splits(700)
    assert len(runs) > 1 and [o for _, own in runs for o in own] == [o for o, _ in whole.blocks]
    assert [i for i, _ in runs] == [sum(len(own) for _, own in runs[:k]) for k in range(len(runs))]


def test_seeks_read_two_blocks_a_file(spark, store):
    files = storage.list_files(store)
    for row in (b"", b"00000", b"00042", b"0004", b"000425", b"00199", b"1"):
        bounds = Bounds(row, seek=True)
        assert all(len(plan(f, bounds).blocks) <= 2 < len(plan(f, Bounds()).blocks) for f in files)
        want = [k for k in (f"{i:05d}".encode() for i in range(200)) if k >= row][:1]
        assert [bytes(r.row) for r in seek_files(spark, store, row, splitBytes="500").collect()] == want


def test_pushdown(spark, store):
    df = enable_pushdown(spark).read.format("cellfile").option("pushdown", "true").load(store)
    assert keys(df.where((F.col("row") > F.lit(b"00100")) & (F.col("row") <= F.lit(b"00103")))) == ["00101", "00102", "00103"]
    assert keys(df.where(F.col("row").isin(bytearray(b"00001"), bytearray(b"00199")))) == ["00001", "00199"]
    assert keys(df.where(F.col("row") == F.lit(b"00042"))) == ["00042"]


def test_bloom_skips_files(spark, store):
    hits = [f for f in storage.list_files(store) if plan(f, Bounds(row=b"00042")).blocks]
    assert len(hits) == 1
    assert keys(register(spark).read.format("cellfile").option("row", "00042").load(store)) == ["00042"]
    assert keys(spark.read.format("cellfile").option("row", "nowhere").load(store)) == []


def test_meta_views(spark, store):
    read = register(spark).read.format("cellfile_meta")
    view = lambda v: read.option("view", v).load(store)
    assert view("trailer").agg(F.sum("entry_count")).first()[0] == 200
    assert {r.compression for r in view("trailer").collect()} == {"GZ"}
    assert view("bloom").agg(F.sum("key_count")).first()[0] == 200
    assert "LASTKEY" in {r.key.split(".")[-1] for r in view("fileinfo").collect()}
    assert view("meta_index").count() == 0
    assert {r.type for r in view("blocks").collect()} >= {"DATA", "BLOOM_CHUNK", "ROOT_INDEX", "FILE_INFO", "GENERAL_BLOOM_META"}
    assert view("index").count() == view("blocks").where("type = 'DATA'").count()


def test_damaged_files(spark, store, tmp_path):
    bad = str(tmp_path / "bad")
    storage.write_file(bad, b"x" * 5000)
    files = spark.createDataFrame([(bad, 0), (storage.list_files(store)[0], 1)], "path string, file_order int")
    with pytest.raises(Exception, match="FormatError"):
        read_files(files).count()
    assert read_files(files, onError="skip").count() > 0
    with pytest.raises(FormatError):
        cellfiles._MetaReader({"path": store, "view": "nonsense"})


def test_columns_option(spark, store):
    df = register(spark).read.format("cellfile").option("columns", "row,qualifier").load(store)
    assert {bytes(r.value) for r in df.select("value").collect()} == {b""}


def test_tagged_files(spark, tmp_path):
    cells = rows(spark, 10).withColumn("tags", F.lit(b"\x00\x02\x01x"))
    write_store(cells, str(tmp_path), partitions=1, encoding="FAST_DIFF").collect()
    df = register(spark).read.format("cellfile").load(str(tmp_path))
    assert {bytes(r.tags) for r in df.collect()} == {b"\x00\x02\x01x"}


def test_files_are_cut_between_rows(spark, tmp_path):
    made = write_store(rows(spark), str(tmp_path), partitions=1, file_bytes=1000).collect()
    assert len(made) > 3 and sum(m.n_cells for m in made) == 200


@pytest.mark.parametrize("by_region", [False, True])
def test_snapshots(spark, tmp_path, by_region):
    folder, data = str(tmp_path / "snap"), str(tmp_path / "data")
    regions = []
    for i, (lo, hi) in enumerate(((b"", b"00100"), (b"00100", b""))):
        r = Region((1 << 64) - 1 - i, b"default", b"t", lo, hi)
        own = rows(spark).where(F.col("row") >= F.lit(lo))
        own = own.where(F.col("row") < F.lit(hi)) if hi else own
        names = []
        for order in range(2):  # the newer file has even rows at a later timestamp
            part = own.where(F.substring("row", 5, 1).cast("string").isin(*"02468")).withColumn("ts", F.lit(50).cast("long")) if order == 0 else own
            path = write_store(part, f"{data}/{r.folder}/cf", partitions=1, prefix=f"f{order}").collect()[0].path
            names.append(StoreFile(path.rsplit("/", 1)[1], 7))
        r.families.append((b"cf", [*names, StoreFile("half", 0, b"k", "BOTTOM")]))
        regions.append(r)
    write_manifest(folder, Manifest(Description("s", "t", 5, "SKIPFLUSH", 1, "me", 9, 10), None, regions), by_region)
    m = read_manifest(folder)
    assert m.schema is None and sorted(r.start_key for r in m.regions) == [b"", b"00100"] and m.description.type == "SKIPFLUSH"
    assert {r.region_id for r in m.regions} == {(1 << 64) - 1, (1 << 64) - 2}
    assert snapshot(spark, folder, "files").where("reference is not null").count() == 2
    cells = scan_snapshot(spark, folder, data, max_versions=1)
    assert cells.count() == 200 and cells.where("ts = 50").count() == 100
    assert scan_snapshot(spark, folder, data, max_versions=0).count() == 300
    assert keys(scan_snapshot(spark, folder, data, start=b"00098", end=b"00102")) == ["00098", "00099", "00100", "00101"]
    assert scan_snapshot(spark, folder, data, raw=True).count() == 300


def test_no_manifest(tmp_path):
    with pytest.raises(FormatError):
        read_manifest(str(tmp_path))


def test_command_line(spark, store, tmp_path, capsys):
    from cellstrata import cli

    file = storage.list_files(store)[0]
    cli.main(["file", file, "--dump"])
    said = capsys.readouterr().out
    assert "trailer:" in said and "compression=GZ" in said and "00000/cf:q/0/Put = 00000" in said and "n_cells=" in said
    r = Region(1, b"default", b"t", b"", b"")
    path = write_store(rows(spark, 5), f"{tmp_path}/data/{r.folder}/cf", partitions=1).collect()[0].path
    r.families.append((b"cf", [StoreFile(path.rsplit("/", 1)[1])]))
    write_manifest(f"{tmp_path}/snap", Manifest(Description("s", "t", 1700000000000), None, [r]))
    cli.main(["snapshot", f"{tmp_path}/snap", f"{tmp_path}/data", "--start-key", "00003", "--print-snapshot", "--print-region", "--print-files", "--print-cells"])
    said = capsys.readouterr().out
    assert "created=2023-11-14T22:13:20Z" in said and "00003/cf:q/3/Put = 00003" in said and "00002/" not in said and r.folder in said and "n_cells=2" in said
