"""Cell files as DataFrames.

``spark.read.format("cellfile").load(path)`` deals files out by byte ranges, as their listing tells
their sizes, and executors read the blocks that begin in a range. :func:`read_files` takes files
listed as rows: executors plan splits of data blocks and tell the file's layout along, so that a split
opens nothing but its blocks. Both decode whole blocks to Arrow arrays in Python workers.

Options: startKey, endKey (UTF-8) or startKeyHex, endKeyHex; row or rowHex for one row, which
skips files by their row bloom filter; columns (comma-separated; others come back empty);
verify (checksums, true); onError (fail or skip the file); splitBytes; seek (true reads only the
blocks where a file's first cell at or after the start key can be); verbose (true
logs requests of storage on the workers' standard error); pushdown (true takes
the bounds from filters on ``row``, for which :func:`enable_pushdown` sets the session up).
"""

from __future__ import annotations

import bisect
import json
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cellstrata.format import storage
from cellstrata.format.errors import FormatError
from cellstrata.format.reader import BLOOM_KEY, CellFile, block_columns
from cellstrata.operators import algebra
from cellstrata.runtime import ship
from cellstrata.schema import CELL

log = logging.getLogger("cellstrata.cellfiles")
BATCH = 8192

FULL = T.StructType([*CELL, T.StructField("file", T.StringType()), T.StructField("file_order", T.IntegerType()), T.StructField("seq", T.LongType())])
_ARROW = pa.schema(
    [("row", pa.binary()), ("family", pa.binary()), ("qualifier", pa.binary()), ("ts", pa.int64()), ("type", pa.int32()), ("value", pa.binary()), ("tags", pa.binary()), ("file", pa.string()), ("file_order", pa.int32()), ("seq", pa.int64())]
)


@dataclass
class Bounds:
    start: bytes = b""
    end: bytes = b""
    row: bytes | None = None
    columns: frozenset | None = None
    verify: bool = True
    skip_errors: bool = False
    split_bytes: int = 32 << 20
    verbose: bool = False
    seek: bool = False

    @classmethod
    def of(cls, options: dict) -> Bounds:
        o = {k.lower(): v for k, v in options.items()}
        key = lambda name: bytes.fromhex(o[name + "hex"]) if o.get(name + "hex") else o.get(name, "").encode()
        row = key("row") if "row" in o or "rowhex" in o else None
        columns = frozenset(c.strip() for c in o["columns"].split(",")) if o.get("columns") else None
        return cls(key("startkey"), key("endkey"), row, columns, o.get("verify", "true") == "true", o.get("onerror", "fail") == "skip", int(o.get("splitbytes", 32 << 20)), o.get("verbose") == "true", o.get("seek") == "true")


def _row(key: bytes) -> bytes:
    return key[2 : 2 + int.from_bytes(key[:2], "big")]


@dataclass
class Plan:
    """A file's data blocks that can hold rows in bounds: its layout, their offsets and sizes, and the first one's number."""

    layout: tuple[int, str, bool]
    first: int
    blocks: list[tuple[int, int]]

    def splits(self, size: int) -> list[tuple[int, list[int]]]:
        """(number of the first block, offsets) of runs of blocks of about ``size`` bytes, one block at least."""
        out, held, total = [], [], 0
        for i, (offset, n) in enumerate(self.blocks, self.first):
            if not held:
                out.append((i, held))
            held.append(offset)
            total += n
            if total >= size:
                held, total = [], 0
        return out


def plan(path: str, b: Bounds) -> Plan:
    if b.verbose:
        storage.log_requests()
    f = storage.RandomAccess(path)
    try:
        file = CellFile(f, b.verify)
        if b.row is not None and file.file_info.get(BLOOM_KEY) == b"ROW" and not file.may_contain(b.row):
            return Plan(file.layout(), 0, [])
        blocks = file.data_blocks()
    finally:
        f.close()
    rows = [_row(k) for _, _, k in blocks]
    start, end = b.start, b.end
    if b.row is not None:
        start, end = max(start, b.row), min(end or b.row + b"\0", b.row + b"\0")
    lo = max(0, bisect.bisect_left(rows, start) - 1) if start else 0
    hi = bisect.bisect_left(rows, end) if end else len(rows)
    if b.seek:  # the block that the start key falls in, or the first cell of the next one
        hi = min(hi, lo + 2 if start else 1)
    return Plan(file.layout(), lo, [(o, n) for o, n, _ in blocks[lo:hi]])


def read_blocks(path: str, order: int, first: int, offsets: list[int], layout: tuple[int, str, bool], b: Bounds) -> Iterator[pa.RecordBatch]:
    if b.verbose:
        storage.log_requests()
    want = lambda c: b.columns is None or c in b.columns
    f = storage.RandomAccess(path)
    held, size = [], 0
    try:
        for n, offset in enumerate(offsets, first):
            columns = block_columns(f, offset, layout, b.verify, want("value"))
            count = len(columns.row)
            if not want("tags"):
                columns = columns._replace(tags=pa.array([b""] * count, pa.binary()))
            place = [pa.array([path] * count, pa.string()), pa.array(np.full(count, order), pa.int32()), pa.array((n << 32) + np.arange(count))]
            batch = _in_bounds(pa.RecordBatch.from_arrays([*columns, *place], schema=_ARROW), b)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BATCH:
                yield from _joined(held)
                held, size = [], 0
        yield from _joined(held)
    finally:
        f.close()


def _in_bounds(batch: pa.RecordBatch, b: Bounds) -> pa.RecordBatch:
    row, fit = batch.column(0), None
    for bound, test in ((b.start, pc.greater_equal), (b.end, pc.less), (b.row, pc.equal)):
        if bound or (bound is not None and test is pc.equal):
            own = test(row, pa.scalar(bound, pa.binary()))
            fit = own if fit is None else pc.and_(fit, own)
    return batch if fit is None else batch.filter(fit)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches, _ARROW).combine_chunks().to_batches() if batches else []


@dataclass
class Split(InputPartition):
    """The blocks of a file that begin in a range of bytes."""

    path: str
    order: int
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.bounds = Bounds.of(options)

    def partitions(self):
        """Byte ranges, from the listing alone: no file is opened here."""
        out, step = [], self.bounds.split_bytes
        files = [f for path in self.paths for f in storage.list_sizes(path)]
        for order, (name, size) in enumerate(files):
            out += [Split(name, order, at, at + step) for at in range(0, max(size, 1), step)]
        return out or [Split("", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        try:
            found = plan(partition.path, self.bounds)
        except (FormatError, OSError) as e:
            if not self.bounds.skip_errors:
                raise
            log.warning("skipped %s: %s", partition.path, e)
            return
        own = [(i, o) for i, (o, _) in enumerate(found.blocks, found.first) if partition.begin <= o < partition.end]
        if own:
            yield from read_blocks(partition.path, partition.order, own[0][0], [o for _, o in own], found.layout, self.bounds)


class _PushdownReader(_Reader):
    """Narrows the bounds by filters on ``row``; Spark applies every filter again."""

    def pushFilters(self, filters):
        b = self.bounds
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, EqualTo):
                    b.row = bytes(f.value)
                elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                    b.start = max(b.start, bytes(f.value))
                elif isinstance(f, LessThan):
                    b.end = min(b.end or bytes(f.value), bytes(f.value))
                elif isinstance(f, LessThanOrEqual):
                    b.end = min(b.end or bytes(f.value) + b"\0", bytes(f.value) + b"\0")
                elif isinstance(f, In) and f.value:
                    rows = sorted(map(bytes, f.value))
                    b.start = max(b.start, rows[0])
                    b.end = min(b.end or rows[-1] + b"\0", rows[-1] + b"\0")
            yield f


class CellFileSource(DataSource):
    @classmethod
    def name(cls):
        return "cellfile"

    def schema(self):
        return FULL

    def reader(self, schema):
        kind = _PushdownReader if self.options.get("pushdown") == "true" else _Reader
        return kind(dict(self.options))


_VIEWS = {
    "trailer": "file string, major int, minor int, entry_count long, data_index_count long, data_index_levels int, meta_index_count long, compression string, comparator string, first_data_block_offset long, last_data_block_offset long, file_info_offset long, load_on_open_offset long, uncompressed_index_size long, total_uncompressed_bytes long",
    "fileinfo": "file string, key string, value binary",
    "index": "file string, position long, block_offset long, data_size int, key binary",
    "meta_index": "file string, position long, block_offset long, data_size int, key binary",
    "bloom": "file string, total_bytes long, hash_count int, hash_type int, key_count long, max_keys long, num_chunks int, comparator string",
    "blocks": "file string, offset long, type string, on_disk_size int, uncompressed_size int, previous_offset long, checksum_type int, bytes_per_checksum int, data_size int",
}


class _MetaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.view, self.verbose = options["path"], options.get("view", "trailer"), options.get("verbose") == "true"
        if self.view not in _VIEWS:
            raise FormatError(f"view {self.view}: one of {', '.join(_VIEWS)}")

    def partitions(self):
        return [Split(name, 0, 0, 0) for name in storage.list_files(self.path)]

    def read(self, partition):
        if self.verbose:
            storage.log_requests()
        f = storage.RandomAccess(partition.path)
        try:
            yield from _meta(partition.path, CellFile(f), self.view)
        finally:
            f.close()


def _meta(path: str, file: CellFile, view: str):
    from cellstrata.format.codec import NAMES

    t = file.trailer
    if view == "trailer":
        yield (path, t.major, t.minor, t.entry_count, t.data_index_count, t.data_index_levels, t.meta_index_count, NAMES[t.compression], t.comparator, t.first_data_block_offset, t.last_data_block_offset, t.file_info_offset, t.load_on_open_offset, t.uncompressed_index_size, t.total_uncompressed_bytes)
    elif view == "fileinfo":
        yield from ((path, k, v) for k, v in sorted(file.file_info.items()))
    elif view in ("index", "meta_index"):
        for i, (offset, size, key) in enumerate(file.index if view == "index" else file.meta_index):
            yield path, i, offset, size, key
    elif view == "bloom" and file.bloom is not None:
        m = file.bloom
        yield path, m.total_bytes, m.hash_count, m.hash_type, m.key_count, m.max_keys, m.num_chunks, m.comparator
    elif view == "blocks":
        for at, h in file.blocks():
            yield path, at, h.type, h.on_disk_size, h.uncompressed_size, h.previous_offset, h.checksum_type, h.bytes_per_checksum, h.data_size


class CellFileMeta(DataSource):
    @classmethod
    def name(cls):
        return "cellfile_meta"

    def schema(self):
        return _VIEWS[self.options.get("view", "trailer")]

    def reader(self, schema):
        return _MetaReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats of this package known to a session."""
    ship(spark)
    from cellstrata.sources.snapshots import SnapshotSource

    for source in (CellFileSource, CellFileMeta, SnapshotSource):
        spark.dataSource.register(source)
    return spark


def enable_pushdown(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return register(spark)


def seek_files(spark: SparkSession, path: str, row: bytes, **options) -> DataFrame:
    """The first cell at or after a row among the cell files below a path: their indexes tell the blocks to read, two a file."""
    cells = register(spark).read.format("cellfile").options(startKeyHex=bytes(row).hex(), seek="true", **options).load(path)
    return algebra.seek(cells, bytes(row))


def read_files(files: DataFrame, **options) -> DataFrame:
    """Cells of the files listed by ``files``: (path, file_order, and any columns, which stay beside the cells).

    Executors plan the splits, the splits are dealt out evenly, and executors read them.
    """
    spark = ship(files.sparkSession)
    bounds = Bounds.of(options)
    extra = [c for c in files.columns if c not in ("path", "file_order")]
    tag = F.struct(*extra) if extra else F.struct(F.lit(0).alias("none"))
    listed = files.select("path", F.col("file_order").cast("int").alias("file_order"), tag.alias("tag"))

    def splits(batches):
        for b in batches:
            paths, orders = b.column(0).to_pylist(), b.column(1).to_pylist()
            at, layouts, firsts, offsets = [], [], [], []
            for i, path in enumerate(paths):
                try:
                    found = plan(path, bounds)
                except (FormatError, OSError) as e:
                    if not bounds.skip_errors:
                        raise
                    log.warning("skipped %s: %s", path, e)
                    continue
                for first, own in found.splits(bounds.split_bytes):
                    at.append(i)
                    layouts.append(json.dumps(found.layout))
                    firsts.append(first)
                    offsets.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([paths[i] for i in at], pa.string()), pa.array([orders[i] for i in at], pa.int32()), b.column(2).take(pa.array(at, pa.int64())), pa.array(layouts, pa.string()), pa.array(firsts, pa.int64()), pa.array(offsets, pa.list_(pa.int64()))],
                ["path", "file_order", "tag", "layout", "first", "offsets"],
            )

    planned = T.StructType([listed.schema["path"], listed.schema["file_order"], listed.schema["tag"], T.StructField("layout", T.StringType()), T.StructField("first", T.LongType()), T.StructField("offsets", T.ArrayType(T.LongType()))])
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = listed.repartition(n, "path").mapInArrow(splits, planned).repartition(n, "path", "first")

    def cells(batches):
        for b in batches:
            for i in range(b.num_rows):
                path, order, layout, first, offsets = (b.column(j)[i].as_py() for j in (0, 1, 3, 4, 5))
                for out in read_blocks(path, order, first, offsets, tuple(json.loads(layout)), bounds):
                    tags = b.column(2).take(pa.array(np.full(out.num_rows, i)))
                    yield pa.RecordBatch.from_arrays([*out.columns, tags], [*_ARROW.names, "tag"])

    full = dealt.mapInArrow(cells, T.StructType([*FULL, listed.schema["tag"]]))
    return full.select(*FULL.names, *[F.col(f"tag.{c}") for c in extra])
