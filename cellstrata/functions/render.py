"""Scalar functions and renderings of cells and metadata, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellstrata.schema import TYPE_NAMES, unsigned_text


def is_printable(data: Column) -> Column:
    """Whether all bytes lie in 0x20 to 0x7e; empty ones do."""
    return F.decode(data, "ISO-8859-1").rlike(r"^[\x20-\x7e]*\z")


def format_bytes(data: Column) -> Column:
    """``<empty>``, the text if printable, else lower-case hex."""
    data = data.cast("binary")
    return F.when(F.octet_length(data) == 0, "<empty>").when(is_printable(data), F.decode(data, "ISO-8859-1")).otherwise(F.lower(F.hex(data)))


def type_name(code: Column) -> Column:
    out = F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")"))
    for k, name in TYPE_NAMES.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def cell_line() -> Column:
    """row/family:qualifier/ts/Type = value"""
    show = lambda c: format_bytes(F.col(c))
    return F.concat(show("row"), F.lit("/"), show("family"), F.lit(":"), show("qualifier"), F.lit("/"), unsigned_text(F.col("ts")), F.lit("/"), type_name(F.col("type")), F.lit(" = "), show("value"))


def table_name(namespace: Column, qualifier: Column) -> Column:
    """``namespace:qualifier``, or the qualifier alone in the default namespace."""
    return F.when(namespace.cast("string") == "default", qualifier.cast("string")).otherwise(F.concat_ws(":", namespace.cast("string"), qualifier.cast("string")))


def region_name(table: Column, start_key: Column, region_id: Column) -> Column:
    """The folder of a region: MD5 of ``table,start key,region id``."""
    return F.md5(F.concat(table.cast("binary"), F.lit(b","), start_key.cast("binary"), F.lit(b","), unsigned_text(region_id).cast("binary")))


def big_endian(data: Column, start: int, size: int) -> Column:
    """An unsigned big-endian number inside bytes (``start`` from 1), as decimal text."""
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10)


def file_info_line(key: Column, value: Column) -> Column:
    """A file info value as shown: lengths and the largest memstore timestamp as numbers, the rest as text or hex."""
    size = F.octet_length(value)
    number = key.isin("hfile.AVG_KEY_LEN", "hfile.AVG_VALUE_LEN") & (size == 4) | (key == "MAX_MEMSTORE_TS_KEY") & (size == 8)
    as_text = (key == "DATA_BLOCK_ENCODING") | (~key.isin("hfile.AVG_KEY_LEN", "hfile.AVG_VALUE_LEN", "MAX_MEMSTORE_TS_KEY") & is_printable(value))
    return F.when(number, F.conv(F.hex(value), 16, 10)).when(as_text, F.decode(value, "ISO-8859-1")).otherwise(F.lower(F.hex(value)))


def creation_time(millis: Column) -> Column:
    """Milliseconds since 1970 as an RFC 3339 time in UTC, whatever the session's time zone; nothing for 0."""
    second = F.floor(millis / 1000)  # a time without a zone, so that none is applied
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.floor(second / 86400).cast("int"), secs=F.pmod(second, F.lit(86400)).cast("decimal(18,6)"))
    return F.when(millis != 0, F.concat(F.replace(F.substring(at.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z")))


def describe_snapshot(description: DataFrame) -> DataFrame:
    """A snapshot's description as shown: what is zero or empty is left out."""
    return description.select(
        "name",
        "table",
        "type",
        "version",
        creation_time(F.col("creation_time")).alias("created"),
        F.when(F.col("owner") != "", F.col("owner")).alias("owner"),
        F.when(F.col("ttl") != 0, F.col("ttl")).alias("ttl"),
    )
