"""The algebra of cells: order, merge, tombstones, versions, row ranges.

All state of a scan is per row, so every window is partitioned by (scope, row) or finer and a
plan needs one exchange on the row. A filter on ``row`` passes below the windows into the source;
a filter on qualifier, timestamp or type must stay above them, as it could take a tombstone away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellstrata.schema import DELETE, DELETE_COLUMN, DELETE_FAMILY, PUT, unsigned

SCOPE = ["family"]

#: Why a put is hidden, the first that holds.
STATUS = {"visible": 0, "family": 1, "column": 2, "version": 3}


def cell_order() -> list[Column]:
    """Row, family and qualifier rising, then the newest timestamp, then the largest type code."""
    return [F.col("row"), F.col("family"), F.col("qualifier"), unsigned(F.col("ts")).desc(), F.col("type").desc()]


def merge_order() -> list[Column]:
    """The cell order; of equal keys the newest file's first, then its own order."""
    return [*cell_order(), F.col("file_order"), F.col("seq")]


def order_cells(cells: DataFrame) -> DataFrame:
    return cells.orderBy(*merge_order())


def merge(*files: DataFrame) -> DataFrame:
    """All cells of several files, newest file first; equal keys stay side by side."""
    ranked = [f.withColumn("file_order", F.lit(i)) for i, f in enumerate(files)]
    return reduce(DataFrame.unionByName, ranked)


def row_range(cells: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from ``start`` on and before ``end``; an empty or missing bound is none."""
    if start:
        cells = cells.where(F.col("row") >= F.lit(start))
    if end:
        cells = cells.where(F.col("row") < F.lit(end))
    return cells


def with_tombstones(cells: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``cells`` with ``delete_status``: 0 visible, 1 hidden by a family marker, 2 by a column marker, 3 by a version's.

    A family marker counts for what sorts after it, so its window runs; a column or version
    marker sorts before all that it can hide. Family and column markers of timestamp 0 hide
    nothing, a version marker of timestamp 0 does. A type without a meaning hides nothing.
    """
    scope = SCOPE if scope is None else scope
    within = [*scope, "row"]
    ts = unsigned(F.col("ts"))
    marks = lambda kind: F.when((F.col("type") == kind) & (F.col("ts") != 0), ts)
    running = Window.partitionBy(*within).orderBy("qualifier", ts.desc(), F.col("type").desc(), "file_order", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    family = F.max(marks(DELETE_FAMILY)).over(running)
    column = F.max(marks(DELETE_COLUMN)).over(Window.partitionBy(*within, "qualifier"))
    version = F.max(F.when(F.col("type") == DELETE, 1).otherwise(0)).over(Window.partitionBy(*within, "qualifier", "ts"))
    status = F.when(F.coalesce(ts <= F.col("_family"), F.lit(False)), STATUS["family"]).when(F.coalesce(ts <= F.col("_column"), F.lit(False)), STATUS["column"]).when(F.col("_version") == 1, STATUS["version"]).otherwise(STATUS["visible"])
    return cells.withColumns({"_family": family, "_column": column, "_version": version}).withColumn("delete_status", status).drop("_family", "_column", "_version")


def limit_versions(puts: DataFrame, max_versions: int, scope: list[str] | None = None) -> DataFrame:
    """The newest ``max_versions`` of each column; equal timestamps count one by one. 0: all."""
    if not max_versions:
        return puts
    scope = SCOPE if scope is None else scope
    newest = Window.partitionBy(*scope, "row", "qualifier").orderBy(unsigned(F.col("ts")).desc(), "file_order", "seq")
    return puts.withColumn("_version", F.row_number().over(newest)).where(F.col("_version") <= max_versions).drop("_version")


def visible_cells(cells: DataFrame, max_versions: int = 0, start=None, end=None, scope: list[str] | None = None) -> DataFrame:
    """What a scan shows: puts in the row range that no tombstone hides, the newest versions of each column."""
    marked = with_tombstones(row_range(cells, start, end), scope)
    puts = marked.where((F.col("type") == PUT) & (F.col("delete_status") == 0)).drop("delete_status")
    return limit_versions(puts, max_versions, scope)


def seek(cells: DataFrame, row) -> DataFrame:
    """The first cell at or after a row."""
    return cells.where(F.col("row") >= F.lit(row)).orderBy(*merge_order()).limit(1)


def raw_key(row: Column, family: Column, qualifier: Column, ts: Column, kind: Column) -> Column:
    """The serialized key less its row: family length, family, qualifier, timestamp and type as bytes."""
    be = lambda c, digits: F.unhex(F.lpad(F.hex(c), digits, "0"))
    return F.concat(be(F.octet_length(family), 2), family.cast("binary"), qualifier.cast("binary"), be(ts, 16), be(kind, 2))


def seek_raw(cells: DataFrame, row, rest: bytes = b"") -> DataFrame:
    """The first cell whose key is at or after (row, rest) in raw order: rows by bytes, then the rest of the key
    by bytes, so timestamps rise. A key without a rest is before all cells of its row."""
    keyed = cells.withColumn("_rest", raw_key(*[F.col(c) for c in ("row", "family", "qualifier", "ts", "type")]))
    at = F.col("row") > F.lit(row)
    at = at | ((F.col("row") == F.lit(row)) & (F.col("_rest") >= F.lit(bytearray(rest)))) if rest else F.col("row") >= F.lit(row)
    return keyed.where(at).orderBy("row", "_rest", "file_order", "seq").limit(1).drop("_rest")


def count_by(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"))
