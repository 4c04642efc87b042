"""Regions: half-open row ranges [start_key, end_key); an empty key is no bound. Regions may overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS, SALTS = 4095, 8


def sort_regions(regions: DataFrame) -> DataFrame:
    return regions.orderBy("start_key")


def prune_regions(regions: DataFrame, start=None, end=None) -> DataFrame:
    """Regions that a row range can touch."""
    if start:
        regions = regions.where((F.length("end_key") == 0) | (F.col("end_key") > F.lit(start)))
    if end:
        regions = regions.where((F.length("start_key") == 0) | (F.col("start_key") < F.lit(end)))
    return regions


def _holds(row: Column) -> Column:
    return (row >= F.col("start_key")) & ((F.length("end_key") == 0) | (row < F.col("end_key")))


def _numbered(cuts: list) -> Callable[[Column, bool], Column]:
    """Number of cuts at or before a key, or only before it: a binary search in a constant array."""
    if not cuts:
        return lambda key, before=False: F.when(key.isNotNull(), F.lit(0))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    known = F.array(*[F.lit(c) for c in cuts])

    def number(key: Column, before: bool = False) -> Column:
        def go(n, step):
            at = F.get(known, n + step - 1)
            return F.when((at < key) if before else (at <= key), n + step).otherwise(n)

        return F.when(key.isNotNull(), F.aggregate(steps, F.lit(0), go))

    return number


def assign_regions(rows: DataFrame, regions: DataFrame, row: str = "row", cuts: int = CUTS, salts: int = SALTS) -> DataFrame:
    """Each row beside every region that holds it.

    The key space is cut at the regions' bounds, or at ``cuts`` of them (those of smallest hash) if there are more.
    A region is listed under every part that it touches, a row under its own, and they meet in a join on the part's
    number, where the bounds decide. Spark sends the regions to all tasks if they are small by their statistics, and
    shuffles both sides if not; rows of one part are then dealt to ``salts`` groups, each beside a copy of its regions.
    """
    some = regions.where((F.length("end_key") == 0) | (F.col("start_key") < F.col("end_key")))
    bounds = some.select(F.explode(F.array("start_key", "end_key")).alias("b")).where(F.length("b") > 0).distinct()
    plain = lambda b: bytes(b) if isinstance(b, bytearray) else b
    known = sorted(plain(r.b) for r in bounds.orderBy(F.xxhash64("b"), "b").limit(cuts).collect())
    number = _numbered(known)
    last = F.when(F.length("end_key") == 0, F.lit(len(known))).otherwise(number(F.col("end_key"), True))
    spread = some.withColumn("_part", F.explode(F.sequence(number(F.col("start_key")), last)))
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumns({"_part": number(F.col(row)), "_salt": (F.monotonically_increasing_id() % salts).cast("int")})
    return dealt.join(spread, ["_part", "_salt"]).where(_holds(F.col(row))).drop("_part", "_salt")


def skip_references(store_files: DataFrame) -> DataFrame:
    """Store files that hold cells themselves: references to another region's file are left out."""
    return store_files.where(F.col("reference").isNull())
