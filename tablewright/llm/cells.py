"""Groups of any size as cells of bounded size: a large group is cut into blocks, a cell holds two of them.

Every pair of rows of a group meets in exactly one cell, and no task holds more than one cell's rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import partitions


def dealt(df: DataFrame, group: str, blocks: Column, by: Column) -> DataFrame:
    """Rows with ``cell_i``, ``cell_j`` and ``block``, once for each cell they belong to, sorted by (group, cell) within partitions."""
    k = blocks.cast("int")
    placed = df.withColumn("_k", k).withColumn("block", F.pmod(F.xxhash64(by), F.col("_k")).cast("int"))
    cells = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
        *df.columns, "block", F.least("block", "_other").alias("cell_i"), F.greatest("block", "_other").alias("cell_j")
    )
    n = partitions(df.sparkSession)
    return cells.repartition(n, group, "cell_i", "cell_j").sortWithinPartitions(group, "cell_i", "cell_j", "block")


def each_cell(batches: Iterator[pa.RecordBatch], group: str, work: Callable[[pa.Table], list | None]) -> Iterator:
    """Results of ``work`` for the rows of each cell; batches come sorted by cell."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in (group, "cell_i", "cell_j")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held:
            last = held[-1]
            same = all(last.column(c)[last.num_rows - 1].as_py() == b.column(c)[0].as_py() for c in (group, "cell_i", "cell_j"))
            if not same:
                yield work(pa.Table.from_batches(held))
                held = []
        at = [0, *cut.tolist(), b.num_rows]
        for x, y in zip(at[:-1], at[1:], strict=True):
            if x:
                yield work(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield work(pa.Table.from_batches(held))
