"""Rows of numbers stored as packed blocks, for operators that read them in many passes.

A block is one binary value: up to ``ROWS`` rows of doubles, row by row. A pass then hands tasks
whole matrices, instead of turning every number of a table into Arrow and back.

Parquet's writer and reader expect small values: they look at sizes only once in 100 values and read a row
group as one batch, so that blocks as they stand would make pages of 80 MB and batches of 128 MB and more in
each task. ``SMALL`` has them look at every value and keeps row groups to a few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a block, as many as Spark hands over in a batch at most by default.
ROWS = 10_000

#: Parquet's settings for a table of blocks: what a task holds at once follows them, whatever the table's size.
SMALL = {"parquet.block.size": str(4 << 20), "parquet.page.size": str(1 << 20), "parquet.page.size.row.check.min": "1",
         "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}


def packed(df: DataFrame, tag: str = "blocks") -> DataFrame:
    """The columns of ``df`` (doubles, a null becomes NaN; longs without nulls, kept bit by bit) as stored blocks."""
    def doubles(c: pa.Array) -> np.ndarray:
        x = c.to_numpy(zero_copy_only=False)
        return x.view(np.float64) if x.dtype == np.int64 else x.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([doubles(c) for c in b.columns])
            parts = [x[i:i + ROWS].tobytes() for i in range(0, len(x), ROWS)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(parts, pa.binary())})

    blocks = materialize(df.mapInArrow(run, "block binary"), tag, **SMALL)
    return blocks.select(F.col("block").alias("block", metadata={"width": len(df.columns)}))


def width(blocks: DataFrame) -> int:
    """Columns of a block."""
    return blocks.schema["block"].metadata["width"]


def unpacked(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """The blocks of a task as matrices, rows x ``columns``."""
    for b in batches:
        for block in b.column(0):
            yield np.frombuffer(block.as_buffer(), np.float64).reshape(-1, columns)
