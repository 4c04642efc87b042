"""Snapshot folders: manifests as DataFrames, and the scan over a snapshot's store files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellstrata.format import storage
from cellstrata.format.errors import FormatError
from cellstrata.format.manifest import read_manifest
from cellstrata.operators import algebra
from cellstrata.plans import regions as plans

_VIEWS = {
    "description": "name string, table string, creation_time long, type string, version int, owner string, ttl long, max_file_size long",
    "schema": "namespace binary, qualifier binary, attributes map<string,string>, configuration map<string,string>, family binary, family_attributes map<string,string>, family_configuration map<string,string>",
    "regions": "position int, region string, region_id long, namespace binary, qualifier binary, start_key binary, end_key binary, offline boolean, split boolean, replica_id int",
    "files": "position int, region string, start_key binary, end_key binary, family_index int, family binary, file_order int, name string, file_size long, reference struct<split_key:binary,range:string>",
}


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _rows(folder: str, view: str):
    m = read_manifest(folder)
    if view == "description":
        d = m.description
        yield d.name, d.table, d.creation_time, d.type, d.version, d.owner, d.ttl, d.max_file_size
    elif view == "schema" and m.schema is not None:
        s = m.schema
        for f in s.families:
            yield s.namespace, s.qualifier, s.attributes, s.configuration, f.name, f.attributes, f.configuration
    elif view == "regions":
        for i, r in enumerate(m.regions):
            yield i, r.folder, _signed(r.region_id), r.namespace, r.qualifier, r.start_key, r.end_key, r.offline, r.split, r.replica_id
    elif view == "files":
        for i, r in enumerate(m.regions):
            for k, (family, files) in enumerate(r.families):
                for n, f in enumerate(files):
                    ref = None if f.split_key is None else {"split_key": f.split_key, "range": f.range}
                    yield i, r.folder, r.start_key, r.end_key, k, family, n, f.name, f.file_size, ref


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.view = options["path"], options.get("view", "regions")
        if self.view not in _VIEWS:
            raise FormatError(f"view {self.view}: one of {', '.join(_VIEWS)}")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from _rows(self.path, self.view)


class SnapshotSource(DataSource):
    """``spark.read.format("cell_snapshot").option("view", ...)``: description, schema, regions or files."""

    @classmethod
    def name(cls):
        return "cell_snapshot"

    def schema(self):
        return _VIEWS[self.options.get("view", "regions")]

    def reader(self, schema):
        return _Reader(dict(self.options))


def snapshot(spark: SparkSession, folder: str, view: str = "regions") -> DataFrame:
    from cellstrata.sources.cellfiles import register

    return register(spark).read.format("cell_snapshot").option("view", view).load(folder)


def store_files(spark: SparkSession, folder: str, data: str, start: bytes = b"", end: bytes = b"") -> DataFrame:
    """Paths of the files that a scan of a row range reads: regions pruned, references to other regions left out."""
    files = plans.skip_references(plans.prune_regions(snapshot(spark, folder, "files"), start, end))
    base = data.rstrip("/") if "://" in data else storage.join_path(data)
    path = F.concat_ws("/", F.lit(base), F.col("region"), F.decode("family", "UTF-8"), "name")
    return files.select(path.alias("path"), "file_order", "region", "start_key", "family_index")


def scan_snapshot(spark: SparkSession, folder: str, data: str, *, start: bytes = b"", end: bytes = b"", max_versions: int = 1, raw: bool = False, on_error: str = "fail", verbose: bool = False) -> DataFrame:
    """Visible cells of a snapshot, or with ``raw`` all of them; ``region``, ``start_key`` and ``family_index`` beside.

    A file's order in its family's manifest ranks it. Only rows in range are read, and
    everything that decides on a cell lies in its region, family and row.
    """
    from cellstrata.sources.cellfiles import read_files

    options = {"startKeyHex": bytes(start).hex(), "endKeyHex": bytes(end).hex(), "onError": on_error, "verbose": str(verbose).lower()}
    cells = read_files(store_files(spark, folder, data, start, end), **options)
    if raw:
        return algebra.row_range(cells, start, end)
    return algebra.visible_cells(cells, max_versions, start, end, scope=["region", "family"])


def in_scan_order(cells: DataFrame) -> DataFrame:
    """Regions by start key, their families as the manifest has them, then the cell order."""
    return cells.orderBy("start_key", "family_index", *algebra.merge_order())
