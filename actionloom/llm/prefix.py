"""Positions and running totals along a global order, from per-partition totals."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionloom.session import stored


class Prefixed(NamedTuple):
    """``rows`` with long columns _row and _before; the number of rows and the sum of sizes."""

    rows: DataFrame
    count: int
    total: int


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the row's place in it and the sizes before it there."""
    part, row, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("_size").to_numpy(zero_copy_only=False)
        upto = before + np.cumsum(sizes, dtype=np.int64)
        numbers = (np.full(batch.num_rows, part), np.arange(row, row + batch.num_rows), upto - sizes)
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(n, k) for n, k in zip(numbers, kinds))],
            names=[*batch.schema.names, "_part", "_row_here", "_before_here"])
        row += batch.num_rows
        before = int(upto[-1]) if len(upto) else before


def prefix_sums(rows: DataFrame, order: Sequence[str], size: str | None = None) -> Prefixed:
    """Every row's place in the order of ``order``, from 0, and the sum of ``size`` before it.

    Rows are range-partitioned, with their place of reading as the last key, so that equal
    rows are dealt out as well. Each partition adds up its own rows; what reaches the driver
    is one row count and one sum per partition. Sums must stay below 2**63. A null size
    counts as 0. Runs a job that stores the rows.
    """
    spark = rows.sparkSession
    sized = rows.select(
        "*", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size") if size else F.lit(1).cast("long").alias("_size"),
        F.monotonically_increasing_id().alias("_read"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.repartitionByRange(parts, *order, "_read").sortWithinPartitions(*order, "_read").drop("_read")
    schema = T.StructType([*ranged.schema.fields, T.StructField("_part", T.IntegerType()),
                           T.StructField("_row_here", T.LongType()), T.StructField("_before_here", T.LongType())])
    numbered = stored(ranged.mapInArrow(_running, schema))
    totals = sorted(tuple(r) for r in numbered.groupBy("_part").agg(
        F.count(F.lit(1)), F.sum("_size")).collect())  # one row per partition
    count, total = sum(t[1] for t in totals), sum(t[2] for t in totals)
    starts = zip([t[0] for t in totals], itertools.accumulate((t[1] for t in totals), initial=0),
                 itertools.accumulate((t[2] for t in totals), initial=0))
    offsets = spark.createDataFrame(list(starts), "_part int, _rows_before long, _sizes_before long")
    placed = numbered.join(F.broadcast(offsets), "_part").select(
        *[F.col(f"`{c}`") for c in rows.columns], (F.col("_rows_before") + F.col("_row_here")).alias("_row"),
        (F.col("_sizes_before") + F.col("_before_here")).alias("_before"))
    return Prefixed(placed, count, total)
