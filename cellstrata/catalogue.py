"""Every registered query of the cell engine and its SQL.

Queries over ``events`` work on a view of it as cells (strings, so that SQL can say the same);
queries over ``orders`` write cell files into the shared scratch folder and read them back.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellstrata.format import storage
from cellstrata.format.bloom import murmur2
from cellstrata.format.manifest import Description, Family, Manifest, Region, Schema, StoreFile, write_manifest
from cellstrata.functions import render
from cellstrata.operators import algebra
from cellstrata.plans import regions as plans
from cellstrata.runtime import scratch_dir, ship
from cellstrata.sources.cellfiles import enable_pushdown, read_files, register, seek_files
from cellstrata.sources.sink import write_store
from cellstrata.sources.snapshots import in_scan_order, scan_snapshot, snapshot

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


# --- Cells made from events ------------------------------------------------------------------------------------

CELLS_SQL = """cells as (select lpad(cast(user_id as varchar), 8, '0') as row_key, 'e' family,
  case when event_id % 40 = 2 then '' else event_type end qualifier, (event_id * 7919) % 50 ts,
  case event_id % 20 when 0 then 8 when 1 then 12 when 2 then 14 when 3 then 10 else 4 end type,
  cast(event_id as varchar) as value, event_id % 3 file_order, event_id seq from events)"""
_MARKED_SQL = f"""{CELLS_SQL}, t as (select *,
  max(case when type = 14 and ts > 0 then ts end) over (partition by family, row_key
    order by qualifier, ts desc, type desc, file_order, seq rows between unbounded preceding and current row) df,
  max(case when type = 12 and ts > 0 then ts end) over (partition by family, row_key, qualifier) dc,
  max(case when type = 8 then 1 else 0 end) over (partition by family, row_key, qualifier, ts) dv from cells),
m as (select *, case when coalesce(ts <= df, false) then 1 when coalesce(ts <= dc, false) then 2 when dv = 1 then 3 else 0 end delete_status from t)"""
_ROWS = "row_key, family, qualifier, ts, value"
START, END = "00000020", "00000060"


def cells_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    kind = F.when(i % 20 == 0, 8).when(i % 20 == 1, 12).when(i % 20 == 2, 14).when(i % 20 == 3, 10).otherwise(4)
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("row"),
        F.lit("e").alias("family"),
        F.when(i % 40 == 2, "").otherwise(F.col("event_type")).alias("qualifier"),
        ((i * 7919) % 50).alias("ts"),
        kind.alias("type"),
        i.cast("string").alias("value"),
        (i % 3).alias("file_order"),
        i.alias("seq"),
    )


def _shown(cells: DataFrame, *more: str) -> DataFrame:
    return cells.select(F.col("row").alias("row_key"), "family", "qualifier", "ts", *more, "value")


def _visible_sql(n: int, where: str = "") -> str:
    return f"""with {_MARKED_SQL}, v as (select *, row_number() over (partition by family, row_key, qualifier order by ts desc, file_order, seq) rn
  from m where type = 4 and delete_status = 0) select {_ROWS} from v where {f'rn <= {n}' if n else 'true'}{where}"""


def _visible(n: int, start=None, end=None):
    return lambda spark, d: _shown(algebra.visible_cells(cells_of_events(spark, d), n, start, end))


_query("cells_view", f"with {CELLS_SQL} select {_ROWS}, type from cells")(lambda s, d: _shown(cells_of_events(s, d), "type"))
_query("visible_all", _visible_sql(0))(_visible(0))
_query("visible_max1", _visible_sql(1))(_visible(1))
_query("visible_max3", _visible_sql(3))(_visible(3))
_query("row_range", _visible_sql(0, f" and row_key >= '{START}' and row_key < '{END}'"))(_visible(0, START, END))
_query("row_range_start_only", _visible_sql(0, f" and row_key >= '{START}'"))(_visible(0, START))
_query("row_range_end_only", _visible_sql(0, f" and row_key < '{END}'"))(_visible(0, None, END))
_query("row_range_empty_bounds", _visible_sql(0))(_visible(0, "", ""))


@_query("cell_type_name", f"with {CELLS_SQL} select seq, case type when 4 then 'Put' when 8 then 'Delete' when 12 then 'DeleteColumn' when 14 then 'DeleteFamily' else 'Unknown(' || type || ')' end type_name from cells")
def cell_type_name(spark, d):
    return cells_of_events(spark, d).select("seq", render.type_name(F.col("type")).alias("type_name"))


@_query("count_by_type", f"with {CELLS_SQL} select type, count(*) n_cells from cells group by type")
def count_by_type(spark, d):
    return algebra.count_by(cells_of_events(spark, d), "type")


@_query("merge_order", f"with {CELLS_SQL} select seq, row_number() over (partition by row_key order by family, qualifier, ts desc, type desc, file_order, seq) place from cells")
def merge_order(spark, d):
    from pyspark.sql import Window

    files = cells_of_events(spark, d)
    merged = algebra.merge(*[files.where(F.col("file_order") == i).drop("file_order") for i in range(3)])
    return merged.select("seq", F.row_number().over(Window.partitionBy("row").orderBy(*algebra.merge_order()[1:])).cast("long").alias("place"))


@_query("merge_no_dedup", f"with {CELLS_SQL} select row_key, family, qualifier, ts, type, count(*) n_cells from cells group by all having count(*) > 1")
def merge_no_dedup(spark, d):
    return algebra.count_by(cells_of_events(spark, d).withColumnRenamed("row", "row_key"), "row_key", "family", "qualifier", "ts", "type").where("n_cells > 1")


@_query("tie_break_newest_file", f"with {CELLS_SQL} select {_ROWS} from cells where type = 4 qualify row_number() over (partition by family, row_key, qualifier order by ts desc, file_order, seq) = 1")
def tie_break_newest_file(spark, d):
    return _shown(algebra.limit_versions(cells_of_events(spark, d).where("type = 4"), 1))


@_query("delete_status", f"with {_MARKED_SQL} select seq, delete_status from m where type = 4")
def delete_status(spark, d):
    return algebra.with_tombstones(cells_of_events(spark, d)).where("type = 4").select("seq", "delete_status")


for _name, _code in (("delete_family", 1), ("delete_column", 2), ("delete_version", 3)):
    _query(_name, f"with {_MARKED_SQL} select {_ROWS} from m where type = 4 and delete_status = {_code}")(
        lambda s, d, c=_code: _shown(algebra.with_tombstones(cells_of_events(s, d)).where((F.col("type") == 4) & (F.col("delete_status") == c)))
    )


@_query("marker_timestamps", f"with {CELLS_SQL} select row_key, qualifier, type, max(ts) max_ts from cells where type in (12, 14) and ts > 0 group by all")
def marker_timestamps(spark, d):
    return cells_of_events(spark, d).where("type in (12, 14) and ts > 0").groupBy(F.col("row").alias("row_key"), "qualifier", "type").agg(F.max("ts").alias("max_ts"))


@_query("visible_count_by_family", f"with v as ({_visible_sql(0)}) select family, count(*) n_cells from v group by 1")
def visible_count_by_family(spark, d):
    return algebra.count_by(algebra.visible_cells(cells_of_events(spark, d)), "family")


@_query("seek_row", f"with {CELLS_SQL} select {_ROWS}, type from cells where row_key >= '000000205' order by row_key, family, qualifier, ts desc, type desc, file_order, seq limit 1")
def seek_row(spark, d):
    return _shown(algebra.seek(cells_of_events(spark, d), "000000205"), "type")


@_query("seek_raw_order", f"with {CELLS_SQL} select {_ROWS}, type from cells where row_key >= '00000021' order by row_key, family, qualifier || chr(0), ts, type, file_order, seq limit 1")
def seek_raw_order(spark, d):
    return _shown(algebra.seek_raw(cells_of_events(spark, d), "00000021"), "type")


@_query("cell_line", f"with {CELLS_SQL} select seq, row_key || '/e:' || case when qualifier = '' then '<empty>' else qualifier end || '/' || ts || '/' || case type when 4 then 'Put' when 8 then 'Delete' when 12 then 'DeleteColumn' when 14 then 'DeleteFamily' else 'Unknown(' || type || ')' end || ' = ' || value line from cells")
def cell_line(spark, d):
    return cells_of_events(spark, d).select("seq", render.cell_line().alias("line"))


@_query("format_bytes", r"select doc_id, case when length(text) = 0 then '<empty>' when regexp_full_match(text, '[\x20-\x7e]*') then text else lower(hex(encode(text))) end shown from documents")
def format_bytes(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", render.format_bytes(F.col("text")).alias("shown"))


@_query("be_integers", "select o_orderkey, o_orderkey as decoded from orders")
def be_integers(spark, d):
    key = F.col("o_orderkey")
    data = F.unhex(F.lpad(F.hex(key), 16, "0"))
    return spark.read.parquet(f"{d}/orders.parquet").select(key, render.big_endian(data, 1, 8).cast("long").alias("decoded"))


@_query("unsigned_timestamps", "select o_orderkey, cast(18446744073709551615 - o_orderkey as varchar) shown, row_number() over (partition by o_orderpriority order by o_orderkey) place from orders")
def unsigned_timestamps(spark, d):
    """Timestamps from 2^63 up: shown unsigned, the newest first."""
    from pyspark.sql import Window

    from cellstrata.schema import unsigned, unsigned_text

    ts = -1 - F.col("o_orderkey")
    newest = Window.partitionBy("o_orderpriority").orderBy(unsigned(ts).desc())
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", unsigned_text(ts).alias("shown"), F.row_number().over(newest).cast("long").alias("place"))


# --- Regions made from nations --------------------------------------------------------------------------------

_REGIONS_SQL = """regions as (select cast(n_nationkey as bigint) region_id, case when n_nationkey = 0 then '' else lpad(cast(n_nationkey * 40 as varchar), 8, '0') end start_key,
  case when n_nationkey = 24 then '' else lpad(cast((n_nationkey + 1) * 40 as varchar), 8, '0') end end_key from nation)"""


def regions_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    key = lambda c: F.lpad(c.cast("string"), 8, "0")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        n.cast("long").alias("region_id"), F.when(n == 0, "").otherwise(key(n * 40)).alias("start_key"), F.when(n == 24, "").otherwise(key((n + 1) * 40)).alias("end_key")
    )


@_query("region_sort", f"with {_REGIONS_SQL} select region_id, row_number() over (order by start_key) place from regions")
def region_sort(spark, d):
    from pyspark.sql import Window

    return plans.sort_regions(regions_of_nations(spark, d)).select("region_id", F.row_number().over(Window.orderBy("start_key")).cast("long").alias("place"))


@_query("region_prune", f"with {_REGIONS_SQL} select * from regions where (end_key = '' or end_key > '00000100') and (start_key = '' or start_key < '00000500')")
def region_prune(spark, d):
    return plans.prune_regions(regions_of_nations(spark, d), "00000100", "00000500")


@_query("region_assign", f"with {CELLS_SQL}, {_REGIONS_SQL} select region_id, count(*) n_cells from cells join regions on row_key >= start_key and (end_key = '' or row_key < end_key) group by 1")
def region_assign(spark, d):
    return algebra.count_by(plans.assign_regions(cells_of_events(spark, d), regions_of_nations(spark, d)), "region_id")


_OVERLAPS_SQL = f"""{_REGIONS_SQL}, lapping as (select region_id, start_key, end_key from regions
  union all select 1000 + region_id, start_key, '' from regions where region_id % 5 = 0
  union all select 2000 + region_id, case when region_id % 2 = 0 then '' else '00000123' end, end_key from regions where region_id % 3 = 0
  union all select 3000 + region_id, start_key, end_key from regions where region_id < 4)"""


def overlapping_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions beside parents that were split, and copies of some."""
    r = regions_of_nations(spark, sf_dir)
    i = F.col("region_id")
    made = lambda df, by, lo, hi: df.select((i + by).alias("region_id"), lo.alias("start_key"), hi.alias("end_key"))
    lo, hi = F.col("start_key"), F.col("end_key")
    parents = made(r.where(i % 5 == 0), 1000, lo, F.lit("")).unionByName(made(r.where(i % 3 == 0), 2000, F.when(i % 2 == 0, "").otherwise("00000123"), hi))
    return r.unionByName(parents).unionByName(made(r.where(i < 4), 3000, lo, hi))


@_query("region_assign_overlap", f"with {CELLS_SQL}, {_OVERLAPS_SQL} select region_id, count(*) n_cells, min(row_key) first_row, max(row_key) last_row from cells join lapping on row_key >= start_key and (end_key = '' or row_key < end_key) group by 1")
def region_assign_overlap(spark, d):
    held = plans.assign_regions(cells_of_events(spark, d), overlapping_regions(spark, d))
    return held.groupBy("region_id").agg(F.count("*").alias("n_cells"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


@_query("region_assign_few_cuts", f"with {CELLS_SQL}, {_OVERLAPS_SQL} select seq, count(*) n_regions, cast(sum(region_id) as bigint) ids from cells join lapping on row_key >= start_key and (end_key = '' or row_key < end_key) group by 1")
def region_assign_few_cuts(spark, d):
    """The same with more bounds than cuts: a part holds several ranges, and the bounds decide."""
    held = plans.assign_regions(cells_of_events(spark, d), overlapping_regions(spark, d), cuts=7)
    return held.groupBy("seq").agg(F.count("*").alias("n_regions"), F.sum("region_id").alias("ids"))


@_query("region_name_md5", f"with {_REGIONS_SQL} select region_id, md5('shop:events,' || start_key || ',' || region_id) as folder, md5('events,' || start_key || ',' || region_id) default_folder from regions")
def region_name_md5(spark, d):
    name = lambda ns: render.region_name(render.table_name(F.lit(ns), F.lit("events")), F.col("start_key"), F.col("region_id"))
    return regions_of_nations(spark, d).select("region_id", name("shop").alias("folder"), name("default").alias("default_folder"))


@_query("split_reference_skip", "select p_partkey, p_name from part where p_partkey % 7 <> 0")
def split_reference_skip(spark, d):
    files = spark.read.parquet(f"{d}/part.parquet").withColumn("reference", F.when(F.col("p_partkey") % 7 == 0, F.struct(F.lit("k").alias("split_key"), F.lit("TOP").alias("range"))))
    return plans.skip_references(files).select("p_partkey", "p_name")


# --- Cell files made from orders ---------------------------------------------------------------------------------

_ORDER_SQL = """oc as (select lpad(cast(o_orderkey as varchar), 10, '0') as row_key, 'priority' qualifier, o_custkey % 1000 ts, o_orderpriority as value from orders
  union all select lpad(cast(o_orderkey as varchar), 10, '0'), 'status', o_custkey % 1000, o_orderstatus from orders
  union all select lpad(cast(o_orderkey as varchar), 10, '0'), 'total', o_custkey % 1000, cast(cast(round(o_totalprice * 100) as bigint) as varchar) from orders)"""
_ORDER_ROWS = "row_key, qualifier, ts, value"


def cells_of_orders(spark: SparkSession, sf_dir: str, tagged: bool = False) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pairs = F.array(
        F.struct(F.lit("priority").alias("q"), F.col("o_orderpriority").alias("v")),
        F.struct(F.lit("status").alias("q"), F.col("o_orderstatus").alias("v")),
        F.struct(F.lit("total").alias("q"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("v")),
    )
    df = o.select("o_orderkey", "o_custkey", F.explode(pairs).alias("p"))
    cells = df.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").cast("binary").alias("row"),
        F.lit(b"o").alias("family"),
        F.col("p.q").cast("binary").alias("qualifier"),
        (F.col("o_custkey") % 1000).alias("ts"),
        F.lit(4).alias("type"),
        F.col("p.v").cast("binary").alias("value"),
    )
    if tagged:  # one tag: its length, type 1, and the qualifier
        cells = cells.withColumn("tags", F.concat(F.lit(b"\0"), F.unhex(F.lpad(F.hex(F.octet_length("qualifier") + 1), 2, "0")), F.lit(b"\x01"), F.col("qualifier")))
    return cells


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, d: str, tagged: bool = False, **options) -> str:
    folder = _folder(spark, "cells")
    write_store(cells_of_orders(spark, d, tagged), folder, **options).collect()  # one row a file
    return folder


def _load(spark: SparkSession, folder: str, **options) -> DataFrame:
    return register(spark).read.format("cellfile").options(**options).load(folder)


def _texts(cells: DataFrame) -> DataFrame:
    text = lambda c: F.decode(c, "UTF-8")
    return cells.select(text("row").alias("row_key"), text("qualifier").alias("qualifier"), "ts", text("value").alias("value"))


def _round_trip(tagged: bool = False, **options):
    return lambda spark, d: _texts(_load(spark, _written(spark, d, tagged, **options)))


for _name, _options in {
    "none": {},
    "gz": {"compression": "GZ"},
    "zstd": {"compression": "ZSTD"},
    "zstd_raw": {"compression": "ZSTD", "framed_zstd": False},
    "snappy": {"compression": "SNAPPY"},
    "fast_diff": {"encoding": "FAST_DIFF", "compression": "SNAPPY"},
    "levels": {"block_size": 512, "fan_out": 8},
}.items():
    _query(f"cellfile_roundtrip_{_name}", f"with {_ORDER_SQL} select {_ORDER_ROWS} from oc")(_round_trip(**_options))


@_query("cellfile_roundtrip_tags", f"with {_ORDER_SQL} select {_ORDER_ROWS}, qualifier tag from oc")
def cellfile_roundtrip_tags(spark, d):
    cells = _load(spark, _written(spark, d, True, encoding="FAST_DIFF"))
    return _texts(cells).drop("value").join(cells.select(F.decode("row", "UTF-8").alias("row_key"), F.decode("qualifier", "UTF-8").alias("qualifier"), F.decode(F.substring("tags", 4, 100), "UTF-8").alias("tag"), F.decode("value", "UTF-8").alias("value")), ["row_key", "qualifier"])


@_query("cellfile_trailer_counts", "select 3 * count(*) entries from orders")
def cellfile_trailer_counts(spark, d):
    meta = register(spark).read.format("cellfile_meta").option("view", "trailer").load(_written(spark, d))
    return meta.agg(F.sum("entry_count").alias("entries"))


@_query("cellfile_avg_lengths", f"with {_ORDER_SQL} select cast(floor(avg(length(row_key) + 1 + length(qualifier) + 12)) as bigint) avg_key, cast(floor(avg(length(value))) as bigint) avg_value from oc")
def cellfile_avg_lengths(spark, d):
    folder = _written(spark, d, partitions=1, file_bytes=1 << 40)
    info = register(spark).read.format("cellfile_meta").option("view", "fileinfo").load(folder)
    number = lambda k: F.max(F.when(F.col("key") == k, render.file_info_line(F.col("key"), F.col("value")).cast("long")))
    return info.agg(number("hfile.AVG_KEY_LEN").alias("avg_key"), number("hfile.AVG_VALUE_LEN").alias("avg_value"))


@_query("cellfile_index_summary", f"with {_ORDER_SQL} select row_key, qualifier, true as places_fit from oc")
def cellfile_index_summary(spark, d):
    """Blocks of one cell each: the data index names every cell, at the places where the blocks lie."""
    folder = _written(spark, d, block_size=1)
    read = register(spark).read.format("cellfile_meta")
    index = read.option("view", "index").load(folder)
    blocks = read.option("view", "blocks").load(folder).where("type = 'DATA'").select("file", F.col("offset").alias("block_offset"), F.lit(True).alias("there"), (F.col("on_disk_size") + 33).alias("size"))
    size = render.big_endian(F.col("key"), 1, 2).cast("int")  # row length, row, family length, family, qualifier, 9 bytes
    row = F.expr("substring(key, 3, cast(conv(hex(substring(key, 1, 2)), 16, 10) as int))")
    family = F.expr("cast(conv(hex(substring(key, 3 + length(row_key), 1)), 16, 10) as int)")
    named = index.withColumn("row_key", row).withColumn("at", 4 + F.length("row_key") + family)
    qualifier = F.expr("substring(key, at, length(key) - at - 8)")
    joined = named.withColumn("qualifier", qualifier).join(blocks, ["file", "block_offset"], "left")
    fit = F.coalesce("there", F.lit(False)) & (F.col("size") == F.col("data_size")) & (size == F.length("row_key"))
    return joined.select(F.decode("row_key", "UTF-8").alias("row_key"), F.decode("qualifier", "UTF-8").alias("qualifier"), fit.alias("places_fit"))


@_query("cellfile_meta_index", "select 'note' as name, 4 + 33 + 4 as size union all select 'origin', 6 + 33 + 4")
def cellfile_meta_index(spark, d):
    """Entries of the meta index: names and sizes on disk of the file's meta blocks (33 bytes of header, one checksum)."""
    folder = _written(spark, d, partitions=1, file_bytes=1 << 40, meta_blocks={"origin": b"orders", "note": b"meta"})
    meta = register(spark).read.format("cellfile_meta").option("view", "meta_index").load(folder)
    return meta.select(F.decode("key", "UTF-8").alias("name"), F.col("data_size").alias("size"))


@_query("cellfile_block_types", "select 'DATA' as type union all select 'BLOOM_CHUNK' union all select 'LEAF_INDEX' union all select 'INTERMEDIATE_INDEX' union all select 'ROOT_INDEX' union all select 'FILE_INFO' union all select 'GENERAL_BLOOM_META'")
def cellfile_block_types(spark, d):
    folder = _written(spark, d, block_size=256, fan_out=4, row_bloom=True)
    return register(spark).read.format("cellfile_meta").option("view", "blocks").load(folder).select("type").distinct()


@_query("checksum_verify", f"with {_ORDER_SQL} select count(*) n_cells from oc")
def checksum_verify(spark, d):
    return _load(spark, _written(spark, d, block_size=40000), verify="true", columns="row").agg(F.count("*").alias("n_cells"))


@_query("checksum_damage", f"with {_ORDER_SQL} select count(*) as n_cells, true as refused, true as read_unverified from oc")
def checksum_damage(spark, d):
    """One byte of a value is changed in every file: verified reading refuses each file, reading without takes it."""
    import pyarrow as pa

    from cellstrata.format.errors import FormatError
    from cellstrata.format.reader import CellFile

    folder = _written(spark, d)
    paths = spark.createDataFrame([(f,) for f in storage.list_files(folder)], "path string")

    def ask(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                data = bytearray(storage.read_file(path))
                size = int.from_bytes(data[33:37], "big")
                data[33 + 8 + size] ^= 1  # the first byte of the first value
                try:
                    refused = list(CellFile(storage.InMemory(bytes(data))).scan()) is None
                except FormatError:
                    refused = True
                n = sum(1 for _ in CellFile(storage.InMemory(bytes(data)), verify=False).scan())
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([refused])], ["n", "refused"])

    asked = paths.mapInArrow(ask, "n long, refused boolean")
    return asked.agg(F.sum("n").alias("n_cells"), F.every("refused").alias("refused"), (F.min("n") > 0).alias("read_unverified"))


@_query("cellfile_range_pushdown", f"with {_ORDER_SQL} select {_ORDER_ROWS} from oc where row_key >= '0000000100' and row_key < '0000000900'")
def cellfile_range_pushdown(spark, d):
    cells = _load(enable_pushdown(spark), _written(spark, d, block_size=4096), pushdown="true")
    return _texts(cells.where((F.col("row") >= F.lit(b"0000000100")) & (F.col("row") < F.lit(b"0000000900"))))


@_query("cellfile_seek", f"with {_ORDER_SQL} select {_ORDER_ROWS} from oc where row_key >= '00000002055' order by row_key, qualifier limit 1")
def cellfile_seek(spark, d):
    """The first cell at or after a key that no row has, found by the files' indexes."""
    return _texts(seek_files(spark, _written(spark, d, block_size=2048, fan_out=8), b"00000002055"))


@_query("bloom_no_false_negative", "select count(*) n_rows, cast(0 as bigint) misses, true as few_false_hits from orders")
def bloom_no_false_negative(spark, d):
    """Each file's filter is asked of its rows, where none may be missed, and of as many rows that are nowhere."""
    import pyarrow as pa

    from cellstrata.format.reader import CellFile

    cells = _load(spark, _written(spark, d, row_bloom=True), columns="row")
    rows = cells.select("file", "row").distinct()

    def ask(key, table):
        with storage.RandomAccess(key[0].as_py()) as f:
            file = CellFile(f)
            own = table.column("row").to_pylist()
            misses = len(own) - int(file.may_contain_all(own).sum())
            false = int((file.may_contain_all([b"x" + r for r in own]) | file.may_contain_all([r[:-1] + b"y" + r[-1:] for r in own])).sum())
        return pa.table({"rows": [len(own)], "misses": [misses], "false_hits": [false]})

    asked = rows.groupBy("file").applyInArrow(ask, "rows long, misses long, false_hits long")
    return asked.agg(F.sum("rows").alias("n_rows"), F.sum("misses").alias("misses"), (F.sum("false_hits") * 20 <= F.sum("rows")).alias("few_false_hits"))


@_query("bloom_point_get", f"with {_ORDER_SQL} select {_ORDER_ROWS} from oc where row_key = '0000000333'")
def bloom_point_get(spark, d):
    return _texts(_load(spark, _written(spark, d, row_bloom=True, block_size=4096), row="0000000333"))


_MURMUR_SQL = """with n as (select n_name, len(n_name) n, list_transform(string_split(n_name, ''), lambda x: cast(ascii(x) as ubigint)) b from nation),
w as (select *, list_transform(range(0, n // 4), lambda i: (b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) * 1540483477 % 4294967296) k from n),
h as (select *, list_reduce(list_prepend(cast(n as ubigint), list_transform(k, lambda x: xor(x, x >> 24) * 1540483477 % 4294967296)), lambda h, x: xor(h * 1540483477 % 4294967296, x)) h1 from w),
r as (select *, list_reduce(list_prepend(cast(0 as ubigint), list_transform(range(0, n % 4), lambda i: b[n - n % 4 + i + 1] << cast(8 * i as int))), lambda x, y: xor(x, y)) rest from h),
f as (select *, case when n % 4 > 0 then xor(h1, rest) * 1540483477 % 4294967296 else h1 end h2 from r),
g as (select n_name, xor(h2, h2 >> 13) * 1540483477 % 4294967296 h3 from f)
select n_name, cast(case when xor(h3, h3 >> 15) >= 2147483648 then cast(xor(h3, h3 >> 15) as bigint) - 4294967296 else xor(h3, h3 >> 15) end as int) hash from g"""


@_query("murmur2", _MURMUR_SQL)
def murmur2_query(spark, d):
    from pyspark.sql.functions import pandas_udf

    ship(spark)
    hashed = pandas_udf(lambda s: s.map(lambda b: murmur2(bytes(b))), "int")
    return spark.read.parquet(f"{d}/nation.parquet").select("n_name", hashed(F.col("n_name").cast("binary")).alias("hash"))


@_query(
    "vint",
    """with v as (select o_orderkey, case o_orderkey % 3 when 0 then o_orderkey when 1 then -o_orderkey else o_orderkey * 1000003 end as number from orders),
s as (select *, case when number < 0 then -1 - number else number end as body from v)
select o_orderkey, number as decoded, cast(case when number between -112 and 127 then 1 when body < 256 then 2 when body < 65536 then 3 when body < 16777216 then 4 when body < 4294967296 then 5 else 6 end as int) size from s""",
)
def vint_query(spark, d):
    """Numbers written with their sign and size in the first byte, and read back."""
    import pyarrow as pa

    from cellstrata.format.wire import read_vint, write_vint

    key = F.col("o_orderkey")
    number = F.when(key % 3 == 0, key).when(key % 3 == 1, -key).otherwise(key * 1000003)

    def through(batches):
        for b in batches:
            written = [write_vint(n) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read_vint(w, 0)[0] for w in written], pa.int64()), pa.array([len(w) for w in written], pa.int32())], ["o_orderkey", "decoded", "size"])

    return ship(spark).read.parquet(f"{d}/orders.parquet").select(key, number).mapInArrow(through, "o_orderkey long, decoded long, size int")


# --- Snapshots made from orders ------------------------------------------------------------------------------------

_SPLITS = (b"", b"0000000500", b"0000002000", b"")


def build_snapshot(spark: SparkSession, sf_dir: str, by_region: bool = False) -> tuple[str, str]:
    """A snapshot of three regions, two families and two files a family; the newer file has deletes and new versions."""
    folder, data = _folder(spark, "snapshot"), _folder(spark, "store")
    cells = cells_of_orders(spark, sf_dir)
    number = F.decode("row", "UTF-8").cast("long")
    newer = cells.where(number % 5 < 2)
    newer = newer.withColumns(
        {
            "type": F.when(number % 5 == 0, F.lit(4)).when(F.col("qualifier") == F.lit(b"total"), F.lit(12)).otherwise(F.lit(4)),
            "ts": F.when(number % 5 == 0, F.col("ts") + 1).otherwise(F.col("ts")),
            "value": F.when(number % 5 == 0, F.lit(b"new")).when(F.col("qualifier") == F.lit(b"total"), F.lit(b"")).otherwise(F.col("value")),
        }
    )
    regions = [Region(1000 + i, b"shop", b"orders", lo, hi) for i, (lo, hi) in enumerate(zip(_SPLITS, _SPLITS[1:], strict=False))]

    def store(what: tuple[Region, bytes, int]) -> list[StoreFile]:
        region, family, order = what
        own = algebra.row_range((newer, cells)[order].withColumn("family", F.lit(family)), region.start_key, region.end_key)
        if family == b"b":
            own = own.where(F.col("qualifier") == F.lit(b"status"))
        path = storage.join_path(data, region.folder, family.decode())
        made = write_store(own, path, partitions=1, file_bytes=1 << 40, prefix=f"f{order}", encoding="FAST_DIFF", compression="ZSTD", row_bloom=True).collect()
        return [StoreFile(m.path.rsplit("/", 1)[1], 1) for m in made]

    jobs = [(r, f, o) for r in regions for f in (b"a", b"b") for o in (0, 1)]
    with ThreadPoolExecutor(len(jobs)) as pool:  # one Spark job a file, side by side
        files = dict(zip([(r.region_id, f, o) for r, f, o in jobs], pool.map(store, jobs), strict=True))
    for r in regions:
        for f in (b"a", b"b"):
            r.families.append((f, [*files[r.region_id, f, 0], *files[r.region_id, f, 1], StoreFile("feedbeef.0123", 1, b"split", "TOP")]))
    schema = Schema(b"shop", b"orders", {"IS_META": "false"}, [Family(b"a", {"VERSIONS": "1"}), Family(b"b", {"BLOOMFILTER": "ROW"})])
    write_manifest(folder, Manifest(Description("orders_snap", "shop:orders", 1700000000000, "FLUSH", 2, "ops"), schema, regions[::-1]), by_region)
    return folder, data


_SNAP_SQL = f"""{_ORDER_SQL}, f as (select 'a' family, * from oc union all select 'b', * from oc where qualifier = 'status'),
s as (select *, cast(row_key as bigint) k from f),
r as (select family, row_key, qualifier, ts, value, 1 file_order, false del from s
  union all select family, row_key, qualifier, ts + 1, 'new', 0, false from s where k % 5 = 0
  union all select family, row_key, qualifier, ts, value, 0, false from s where k % 5 = 1 and qualifier <> 'total'
  union all select family, row_key, qualifier, ts, '', 0, true from s where k % 5 = 1 and qualifier = 'total'),
d as (select *, max(case when del and ts > 0 then ts end) over (partition by family, row_key, qualifier) dc from r),
v as (select *, row_number() over (partition by family, row_key, qualifier order by ts desc, file_order) rn from d where not del and not coalesce(ts <= dc, false))"""


def _snap_rows(cells: DataFrame) -> DataFrame:
    return _texts(cells).select("row_key", "qualifier", "ts", "value") if "family" not in cells.columns else cells.select(
        F.decode("family", "UTF-8").alias("family"), F.decode("row", "UTF-8").alias("row_key"), F.decode("qualifier", "UTF-8").alias("qualifier"), "ts", F.decode("value", "UTF-8").alias("value")
    )


@_query("snapshot_scan", f"with {_SNAP_SQL} select family, row_key, qualifier, ts, value from v where rn <= 1")
def snapshot_scan(spark, d):
    return _snap_rows(in_scan_order(scan_snapshot(spark, *build_snapshot(spark, d), max_versions=1)))


@_query("snapshot_scan_range", f"with {_SNAP_SQL} select family, row_key, qualifier, ts, value from v where row_key >= '0000000400' and row_key < '0000000700'")
def snapshot_scan_range(spark, d):
    return _snap_rows(scan_snapshot(spark, *build_snapshot(spark, d), start=b"0000000400", end=b"0000000700", max_versions=0))


@_query("snapshot_region_manifests", f"with {_SNAP_SQL} select case when row_key < '0000000500' then 1000 when row_key < '0000002000' then 1001 else 1002 end region_id, count(*) n_cells from v group by 1")
def snapshot_region_manifests(spark, d):
    """The same snapshot with a manifest for each region instead of one for all."""
    folder, data = build_snapshot(spark, d, by_region=True)
    regions = snapshot(spark, folder, "regions").select(F.col("region_id").cast("int").alias("region_id"), "region")
    cells = scan_snapshot(spark, folder, data, max_versions=0)
    return cells.groupBy("region").agg(F.count("*").alias("n_cells")).join(regions, "region").select("region_id", "n_cells")


@_query("snapshot_visible_counts", f"with {_SNAP_SQL} select family, case when row_key < '0000000500' then '' when row_key < '0000002000' then '0000000500' else '0000002000' end start_key, count(*) n_cells from v group by all")
def snapshot_visible_counts(spark, d):
    cells = scan_snapshot(spark, *build_snapshot(spark, d), max_versions=0)
    return cells.groupBy(F.decode("family", "UTF-8").alias("family"), F.decode("start_key", "UTF-8").alias("start_key")).agg(F.count("*").alias("n_cells"))


@_query("snapshot_raw_cells", f"with {_SNAP_SQL} select file_order, count(*) n_cells from r group by 1")
def snapshot_raw_cells(spark, d):
    return algebra.count_by(scan_snapshot(spark, *build_snapshot(spark, d), raw=True), "file_order")


@_query(
    "snapshot_regions",
    "select * from (values (1000, md5('shop:orders,,1000'), '', '0000000500'), (1001, md5('shop:orders,0000000500,1001'), '0000000500', '0000002000'), (1002, md5('shop:orders,0000002000,1002'), '0000002000', '')) t(region_id, folder, start_key, end_key)",
)
def snapshot_regions(spark, d):
    r = plans.sort_regions(snapshot(spark, build_snapshot(spark, d)[0], "regions"))
    name = render.region_name(render.table_name(F.decode("namespace", "UTF-8"), F.decode("qualifier", "UTF-8")), F.col("start_key"), F.col("region_id"))
    return r.where(F.col("region") == name).select(F.col("region_id").cast("int").alias("region_id"), F.col("region").alias("folder"), F.decode("start_key", "UTF-8").alias("start_key"), F.decode("end_key", "UTF-8").alias("end_key"))


@_query("snapshot_schema", "select * from (values ('shop:orders', 'a', 'VERSIONS=1'), ('shop:orders', 'b', 'BLOOMFILTER=ROW')) t(table_name, family, attributes)")
def snapshot_schema(spark, d):
    s = snapshot(spark, build_snapshot(spark, d)[0], "schema")
    return s.select(
        render.table_name(F.decode("namespace", "UTF-8"), F.decode("qualifier", "UTF-8")).alias("table_name"),
        F.decode("family", "UTF-8").alias("family"),
        F.array_join(F.transform(F.map_entries("family_attributes"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("attributes"),
    )


@_query("snapshot_description", "select 'orders_snap' as name, 'shop:orders' as table_name, 'FLUSH' as type, 2 as version, '2023-11-14T22:13:20Z' created, 'ops' as owner")
def snapshot_description(spark, d):
    return render.describe_snapshot(snapshot(spark, build_snapshot(spark, d)[0], "description")).drop("ttl").withColumnRenamed("table", "table_name")


@_query("snapshot_references", "select 6 as skipped, cast(4 * count(distinct case when o_orderkey < 500 then 0 when o_orderkey < 2000 then 1 else 2 end) as int) read_files from orders")
def snapshot_references(spark, d):
    files = snapshot(spark, build_snapshot(spark, d)[0], "files")
    return files.agg(F.count("reference").cast("int").alias("skipped"), F.count(F.when(F.col("reference").isNull(), 1)).cast("int").alias("read_files"))


@_query("unreadable_files_skip", f"with {_ORDER_SQL} select count(*) n_cells from oc")
def unreadable_files_skip(spark, d):
    folder = _written(spark, d)
    storage.write_file(storage.join_path(folder, "zzz-damaged"), b"not a cell file")
    files = [(f, i) for i, f in enumerate(storage.list_files(folder))]
    return read_files(spark.createDataFrame(files, "path string, file_order int"), onError="skip").agg(F.count("*").alias("n_cells"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
