"""Writes cells as cell files, one or more for each partition of row ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cellstrata.format import storage
from cellstrata.format.cells import Columns, bytes_of
from cellstrata.format.writer import FileWriter
from cellstrata.operators.algebra import cell_order
from cellstrata.runtime import ship

FILE_BYTES = 64 << 20


def _columns(b: pa.RecordBatch) -> Columns:
    row, family, qualifier, ts, kind, value, *tags = b.columns
    binary = [x.cast(pa.binary()) for x in (row, family, qualifier, value, *(tags or [pa.repeat(pa.scalar(b"", pa.binary()), b.num_rows)]))]
    return Columns(*binary[:3], ts.cast(pa.int64()), kind.cast(pa.int32()), *binary[3:])


def write_store(cells: DataFrame, folder: str, *, partitions: int = 4, file_bytes: int = FILE_BYTES, prefix: str = "part", **options) -> DataFrame:
    """Writes (row, family, qualifier, ts, type, value[, tags]) and returns (path, n_cells), once collected.

    Ranges of rows make partitions, a partition is sorted and cut into files of about ``file_bytes``
    between rows, and names follow from the partition, so a task that runs again writes the same files.
    Blocks go to storage as they fill: memory doesn't follow the size of a file.
    """
    ship(cells.sparkSession)
    names = ["row", "family", "qualifier", "ts", "type", "value", *(["tags"] if "tags" in cells.columns else [])]
    df = cells.select(*names).repartitionByRange(partitions, "row").sortWithinPartitions(*cell_order())
    tagged = len(names) == 7

    def run(batches):
        index, made, last = TaskContext.get().partitionId(), 0, None
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        while batch is not None:
            path, size = storage.join_path(folder, f"{prefix}-{index:05d}-{made:05d}"), 0
            with storage.writing(path) as f:
                file = FileWriter(f, tagged=tagged, **options)
                while batch is not None:
                    c = _columns(batch)
                    sizes = sum(bytes_of(x)[2] for x in (c.row, c.qualifier, c.value)) + 32
                    before = size + np.cumsum(sizes) - sizes
                    row = c.row if last is None else pa.concat_arrays([last, c.row])
                    new = np.concatenate([[False] * (len(c.row) - len(row) + 1), ~np.asarray(pc.equal(row[1:], row[:-1]))]).astype(bool)
                    full = np.flatnonzero(new & (before >= file_bytes) & (before > 0))
                    n = int(full[0]) if len(full) else batch.num_rows
                    if n:
                        file.add(Columns(*(x[:n] for x in c)))
                        size, last = int(before[n - 1] + sizes[n - 1]), c.row[n - 1 : n]
                    batch = batch.slice(n)
                    if n < len(sizes):
                        break
                    batch = next(batches, None)
                file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.total], pa.int64())], ["path", "n_cells"])
            made += 1

    return df.mapInArrow(run, "path string, n_cells long")
