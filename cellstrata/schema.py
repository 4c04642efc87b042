"""The cell: one row of every source and operator.

``ts`` holds the bits of an unsigned 64-bit number; order it with :func:`unsigned`.
``file_order`` ranks the files that a scan merges, newest first; ``seq`` is a cell's place in its file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type codes of cells.
PUT, DELETE, DELETE_COLUMN, DELETE_FAMILY = 4, 8, 12, 14
TYPE_NAMES = {PUT: "Put", DELETE: "Delete", DELETE_COLUMN: "DeleteColumn", DELETE_FAMILY: "DeleteFamily"}

KEY = ["row", "family", "qualifier", "ts", "type"]

CELL = T.StructType(
    [
        T.StructField("row", T.BinaryType(), False),
        T.StructField("family", T.BinaryType(), False),
        T.StructField("qualifier", T.BinaryType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("type", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), False),
        T.StructField("tags", T.BinaryType(), False),
    ]
)


def unsigned(column: Column) -> Column:
    """Orders and compares a LONG as the unsigned number of the same bits."""
    return column.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_text(column: Column) -> Column:
    """The unsigned number in decimal."""
    return F.conv(F.hex(column), 16, 10)
