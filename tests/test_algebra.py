"""The cell algebra against the fixture cases and a straight-line simulation of a scan."""

import random

import pytest
from pyspark.sql import functions as F

from cellstrata.functions import render
from cellstrata.operators import algebra
from cellstrata.plans import regions as plans
from cellstrata.schema import CELL, DELETE, DELETE_COLUMN, DELETE_FAMILY, PUT

COLS = "row binary, family binary, qualifier binary, ts long, type int, value binary, file_order int, seq long"


def cells(spark, rows):
    """rows: (row, qualifier, ts, type[, file order])"""
    data = [(bytearray(r[0]), bytearray(b"cf"), bytearray(r[1]), r[2], r[3], bytearray(b"v"), r[4] if len(r) > 4 else 0, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, COLS)


def shown(df):
    return [(bytes(r.row), bytes(r.qualifier), r.ts) for r in algebra.order_cells(df).collect()]


def scan(rows, max_versions=0, start=b"", end=b""):
    """What a scan does, cell by cell in merge order."""
    unsigned = lambda t: t % (1 << 64)
    out, row = [], None
    order = sorted(enumerate(rows), key=lambda ir: (ir[1][0], ir[1][1], -unsigned(ir[1][2]), -ir[1][3], ir[1][4], ir[0]))
    for _, (r, q, ts, kind, _) in order:
        if (start and r < start) or (end and r >= end):
            continue
        if r != row:
            row, family, columns, versions, seen = r, 0, {}, set(), {}
        t = unsigned(ts)
        if kind == DELETE_FAMILY:
            family = max(family, t)
        elif kind == DELETE_COLUMN:
            columns[q] = max(columns.get(q, 0), t)
        elif kind == DELETE:
            versions.add((q, t))
        elif kind == PUT:
            if (family and t <= family) or (columns.get(q) and t <= columns[q]) or (q, t) in versions:
                continue
            seen[q] = seen.get(q, 0) + 1
            if not max_versions or seen[q] <= max_versions:
                out.append((r, q, ts))
    return out


CASES = {
    "nothing hides": ([(b"ant", b"w", 7, PUT), (b"bee", b"w", 7, PUT), (b"cow", b"x", 3, PUT)], 0, [(b"ant", b"w", 7), (b"bee", b"w", 7), (b"cow", b"x", 3)]),
    "two files interleave": ([(b"elk", b"a", 31, PUT, 1), (b"elk", b"b", 29, PUT, 0), (b"elk", b"a", 30, PUT, 0), (b"elk", b"b", 28, PUT, 1)], 0, [(b"elk", b"a", 31), (b"elk", b"a", 30), (b"elk", b"b", 29), (b"elk", b"b", 28)]),
    "a version marker hides its own stamp only": ([(b"fox", b"k", 12, PUT), (b"fox", b"k", 11, DELETE), (b"fox", b"k", 11, PUT), (b"fox", b"k", 10, PUT)], 0, [(b"fox", b"k", 12), (b"fox", b"k", 10)]),
    "a column marker hides what is older in its column": ([(b"gnu", b"k", 9, PUT), (b"gnu", b"k", 8, DELETE_COLUMN), (b"gnu", b"k", 8, PUT), (b"gnu", b"k", 2, PUT), (b"gnu", b"l", 1, PUT)], 0, [(b"gnu", b"k", 9), (b"gnu", b"l", 1)]),
    "a family marker ends with its row": ([(b"hen", b"", 50, DELETE_FAMILY), (b"hen", b"k", 50, PUT), (b"hen", b"l", 51, PUT), (b"ibis", b"k", 4, PUT)], 0, [(b"hen", b"l", 51), (b"ibis", b"k", 4)]),
    "a marker in an older file": ([(b"jay", b"k", 6, PUT, 0), (b"jay", b"k", 5, DELETE, 2), (b"jay", b"k", 5, PUT, 1)], 0, [(b"jay", b"k", 6)]),
    "two versions a column": ([(b"kid", b"a", t, PUT) for t in (5, 4, 3)] + [(b"kid", b"b", 1, PUT)], 2, [(b"kid", b"a", 5), (b"kid", b"a", 4), (b"kid", b"b", 1)]),
    "hidden versions do not count": ([(b"lark", b"a", 5, DELETE), (b"lark", b"a", 5, PUT), (b"lark", b"a", 4, PUT), (b"lark", b"a", 3, PUT)], 1, [(b"lark", b"a", 4)]),
    "family marker that sorts late": ([(b"r", b"a", 100, PUT), (b"r", b"b", 200, DELETE_FAMILY), (b"r", b"c", 100, PUT)], 0, [(b"r", b"a", 100)]),
    "markers of timestamp 0": ([(b"r", b"", 0, DELETE_FAMILY), (b"r", b"q", 0, DELETE_COLUMN), (b"r", b"q", 0, PUT)], 0, [(b"r", b"q", 0)]),
    "version marker of timestamp 0": ([(b"r", b"q", 0, DELETE), (b"r", b"q", 0, PUT)], 0, []),
    "unknown types": ([(b"r", b"q", 9, 10), (b"r", b"q", 5, PUT)], 0, [(b"r", b"q", 5)]),
    "timestamps from 2^63 up are the newest": ([(b"r", b"q", -1, PUT), (b"r", b"q", 5, PUT)], 1, [(b"r", b"q", -1)]),
    "equal keys are versions": ([(b"r", b"q", 5, PUT, 0), (b"r", b"q", 5, PUT, 1)], 1, [(b"r", b"q", 5)]),
    "empty": ([], 0, []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, versions, expected = CASES[name]
    assert shown(algebra.visible_cells(cells(spark, rows), versions)) == expected


@pytest.mark.parametrize("seed", range(4))
def test_like_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([b"a", b"b", b"bb", b"c"]), rng.choice([b"", b"p", b"q", b"\xff"]), rng.choice([0, 1, 2, 3, -1]), rng.choice([4, 4, 4, 4, 8, 12, 14, 10]), rng.randrange(3)) for _ in range(150)]
    df = cells(spark, rows)
    for versions, start, end in ((0, b"", b""), (1, b"", b""), (2, b"b", b""), (0, b"", b"bb"), (1, b"b", b"c")):
        assert sorted(shown(algebra.visible_cells(df, versions, start, end))) == sorted(scan(rows, versions, start, end))


def test_merge_keeps_all_and_ranks_files(spark):
    a = cells(spark, [(b"row1", b"q", 100, PUT), (b"row3", b"q", 100, PUT)]).drop("file_order")
    b = cells(spark, [(b"row1", b"q", 100, PUT), (b"row2", b"q", 100, PUT)]).drop("file_order")
    got = algebra.order_cells(algebra.merge(a, b)).select("row", "file_order").collect()
    assert [(bytes(r.row), r.file_order) for r in got] == [(b"row1", 0), (b"row1", 1), (b"row2", 1), (b"row3", 0)]


def test_seeks(spark):
    df = cells(spark, [(b"row-%02d" % i, b"q", 1700, PUT) for i in range(20)])
    first = lambda f: [bytes(r.row) for r in f.collect()]
    assert first(algebra.seek(df, b"row-042")) == [b"row-05"] and first(algebra.seek(df, b"z")) == []
    rest = b"\x02cfq" + b"\xff" * 8 + b"\x04"
    assert first(algebra.seek_raw(df, b"row-04", rest)) == [b"row-05"]
    assert first(algebra.seek_raw(df, b"row-04")) == [b"row-04"]
    assert first(algebra.seek_raw(df, b"row-04", b"\x02cfq" + (1700).to_bytes(8, "big") + b"\x04")) == [b"row-04"]


def test_range_filter_goes_below_the_windows(spark):
    df = algebra.visible_cells(cells(spark, [(b"a", b"q", 1, PUT)]), 1).where(F.col("row") >= F.lit(b"b"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window") < plan.index("Filter", plan.rindex("Window")) or "LocalRelation <empty>" in plan


def test_one_exchange(spark):
    df = spark.range(1000).selectExpr("cast(cast(id % 50 as string) as binary) row", "cast('e' as binary) family", "cast('q' as binary) qualifier", "id % 7 ts", "4 type", "cast('v' as binary) value", "0 file_order", "id seq")
    plan = algebra.visible_cells(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rendering(spark):
    data = [(bytearray(b""),), (bytearray(b"abc"),), (bytearray(b"a\n"),), (bytearray(b"\xff\x00"),)]
    df = spark.createDataFrame(data, "b binary")
    assert [r.s for r in df.select(render.format_bytes(F.col("b")).alias("s")).collect()] == ["<empty>", "abc", "610a", "ff00"]
    line = cells(spark, [(b"r", b"", -1, 12)]).select(render.cell_line().alias("l")).first().l
    assert line == "r/cf:<empty>/18446744073709551615/DeleteColumn = v"
    assert [f.name for f in CELL][:2] == ["row", "family"]


def test_regions(spark):
    regions = spark.createDataFrame([("", "d", 1), ("d", "m", 2), ("m", "", 3)], "start_key string, end_key string, id int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(plans.prune_regions(regions, "d", "e")) == [2]
    assert ids(plans.prune_regions(regions, "", "d")) == [1]
    assert ids(plans.prune_regions(regions)) == [1, 2, 3]


@pytest.mark.parametrize("cuts", [0, 1, 3, 4095])
@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_every_region_that_holds_a_row(spark, cuts, threshold):
    """Regions may overlap, and neither their number nor the join's kind changes the result."""
    rng = random.Random(cuts)
    key = lambda: rng.choice(["", *[f"{chr(97 + rng.randrange(26))}{rng.choice(['', 'a', 'm', 'zz'])}" for _ in range(6)]])
    regions = [("", "z", 100), ("b", "c", 101), ("", "", 102), ("m", "c", 103), ("q", "q", 104), *[(key(), key(), i) for i in range(40)]]
    rows = ["a", "bb", "d", "", "zzz", "q", *[key() for _ in range(60)], *["hot"] * 300]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        keyed = spark.createDataFrame([(r,) for r in [*rows, None]], "row string")
        got = plans.assign_regions(keyed, spark.createDataFrame(regions, "start_key string, end_key string, id int"), cuts=cuts).collect()
        none = plans.assign_regions(keyed, spark.createDataFrame([], "start_key string, end_key string, id int"), cuts=cuts)
        assert none.count() == 0 and none.columns == ["row", "start_key", "end_key", "id"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.row, r.id) for r in got) == sorted((r, i) for r in rows for lo, hi, i in regions if r >= lo and (not hi or r < hi))


def test_binary_keys_meet_regions(spark):
    regions = spark.createDataFrame([(bytearray(b""), bytearray(b"\x80"), 1), (bytearray(b"\x7f"), bytearray(b""), 2)], "start_key binary, end_key binary, id int")
    rows = spark.createDataFrame([(bytearray(b),) for b in (b"\x00", b"\x7f\xff", b"\xff")], "row binary")
    got = sorted((bytes(r.row), r.id) for r in plans.assign_regions(rows, regions).collect())
    assert got == [(b"\x00", 1), (b"\x7f\xff", 1), (b"\x7f\xff", 2), (b"\xff", 2)]
