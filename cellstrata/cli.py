"""Command line: ``python -m cellstrata.cli file PATH [--dump]`` and ``... snapshot FOLDER DATA [options]``.

The functions return what is printed as DataFrames.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellstrata.format import storage
from cellstrata.functions import render
from cellstrata.operators import algebra
from cellstrata.sources import snapshots
from cellstrata.sources.cellfiles import register


def inspect_file(spark: SparkSession, path: str, dump: bool = False, verbose: bool = False) -> dict[str, DataFrame]:
    """Trailer, file info, data index summary and bloom filter of cell files; with ``dump`` all cells as lines."""
    told = {"verbose": str(verbose).lower()}
    view = lambda v: register(spark).read.format("cellfile_meta").options(view=v, **told).load(path)
    index = view("index").groupBy("file").agg(
        F.count("*").alias("entries"), F.min_by("block_offset", "position").alias("first_block_offset"), F.max_by("block_offset", "position").alias("last_block_offset")
    )
    out = {
        "trailer": view("trailer").drop("uncompressed_index_size"),
        "file info": view("fileinfo").select("file", "key", render.file_info_line(F.col("key"), F.col("value")).alias("value")).orderBy("file", "key"),
        "data index": index,
        "meta index": view("meta_index").select("file", F.decode("key", "UTF-8").alias("name"), "block_offset", "data_size"),
        "bloom filter": view("bloom"),
    }
    if dump:
        cells = spark.read.format("cellfile").options(**told).load(path)
        out["cells"] = cells.orderBy("file_order", "seq").select(render.cell_line().alias("cell"))
        out["cell count"] = algebra.count_by(cells, "file")
    return out


def inspect_snapshot(spark: SparkSession, folder: str, data: str, *, start: bytes = b"", end: bytes = b"", max_versions: int = 1, show: tuple[str, ...] = ("snapshot", "region", "cells"), verbose: bool = False) -> dict[str, DataFrame]:
    """Description, schema, regions, store files and visible cells of a snapshot, as asked for by ``show``."""
    from cellstrata.plans.regions import prune_regions, sort_regions

    out = {}
    text = lambda c: render.format_bytes(F.col(c)).alias(c)
    name = render.table_name(F.decode("namespace", "UTF-8"), F.decode("qualifier", "UTF-8")).alias("table")
    if "snapshot" in show:
        out["snapshot"] = render.describe_snapshot(snapshots.snapshot(spark, folder, "description"))
        out["families"] = snapshots.snapshot(spark, folder, "schema").select(name, text("family"), "family_attributes", "family_configuration")
    if "region" in show:
        regions = sort_regions(prune_regions(snapshots.snapshot(spark, folder, "regions"), start, end))
        out["regions"] = regions.select("region", "region_id", name, text("start_key"), text("end_key"), "offline", "split", "replica_id")
    if "files" in show:
        listed = snapshots.store_files(spark, folder, data, start, end).select("path").collect()
        for r in listed:
            out |= {f"{k} of {r.path}": v for k, v in inspect_file(spark, r.path, verbose=verbose).items()}
    if "cells" in show:
        cells = snapshots.scan_snapshot(spark, folder, data, start=start, end=end, max_versions=max_versions, verbose=verbose)
        out["cells"] = snapshots.in_scan_order(cells).select(render.cell_line().alias("cell"))
        out["visible cells"] = algebra.count_by(cells, "region", "family").withColumn("family", F.decode("family", "UTF-8"))
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cellstrata")
    parser.add_argument("--verbose", action="store_true", help="log storage requests")
    commands = parser.add_subparsers(dest="command", required=True)
    file = commands.add_parser("file")
    file.add_argument("path")
    file.add_argument("--dump", action="store_true")
    snap = commands.add_parser("snapshot")
    snap.add_argument("folder")
    snap.add_argument("data")
    snap.add_argument("--start-key", default="")
    snap.add_argument("--end-key", default="")
    snap.add_argument("--max-versions", type=int, default=1)
    for part in ("snapshot", "region", "files", "cells"):
        snap.add_argument(f"--print-{part}", action="append_const", dest="show", const=part)
    given = parser.parse_args(args)
    if given.verbose:
        storage.log_requests()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "file":
        parts = inspect_file(spark, given.path, given.dump, given.verbose)
    else:
        parts = inspect_snapshot(spark, given.folder, given.data, start=given.start_key.encode(), end=given.end_key.encode(), max_versions=given.max_versions, show=tuple(given.show or ("snapshot",)), verbose=given.verbose)
    for title, df in parts.items():
        print(f"{title}:")
        for r in df.toLocalIterator():
            print("  " + (r[0] if len(r) == 1 else ", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None)))


if __name__ == "__main__":
    main()
