"""Best-fit packing of token sequences, planned on the histogram of piece lengths.

Documents are encoded and cut into pieces once. Only the number of pieces per length
reaches the driver, at most ``capacity`` numbers. Best fit, longest first, is run on these
counts: a run of equal sequences takes as many pieces of a length as fit, at once. The
plan says for each length which ranks go to which run of sequences and where. Pieces get
their rank within their length from the number of such pieces in earlier tasks and before
them in their own task, so no length is sorted or gathered, and join the plan on it.

Defined results: a null or empty text is one piece that holds the end id alone. Repeated
rows are packed as often as they occur. An empty table gives an empty result. Other
columns are ignored. Which of two equally long pieces takes which slot is not specified.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actionloom.llm.byte_bpe import encoder
from actionloom.llm.common import slices, text_or_empty
from actionloom.session import stored

CAPACITY = 1024
END_ID = 2
PLAN_SCHEMA = "p_length long, rank_from long, rank_to long, sequence_from long, per_sequence long, place long"


def piece_bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces; where one is shorter, it is the first."""
    first = total % capacity or min(total, capacity)
    cuts = [0, *range(first, total + 1, capacity)]
    return list(zip(cuts, cuts[1:]))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth): nth counts pieces of a length in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer_path).encode, Counter()
        end, task = end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                names, rows = part.column(0), []
                for row, ids in enumerate(map(encode, part.column(1).to_pylist())):
                    ids += end
                    for piece, (a, b) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                        rows.append((row, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b]), task, seen[b - a]))
                        seen[b - a] += 1
                row, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(row)), pa.array(rest[0], pa.int32()),
                     *[pa.array(x, pa.int64()) for x in rest[1:4]], pa.array(rest[4], pa.int32()),
                     pa.array(rest[5], pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "task", "nth"])

    if sys.byteorder != "little":
        raise RuntimeError("ids are laid out for little-endian machines")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``PLAN_SCHEMA`` that place every piece; ranks within a length count from 0.

    Each step uses up a run of equal sequences or the pieces of a length, so there are at
    most a few rows per length and per remaining room, however many pieces there are.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs (first sequence, how many)
    free: list[int] = []  # the keys of room, ascending
    plan, sequences = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            at = bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left], free[at]
            else:
                left, first, count = capacity, sequences, -(-n // (capacity // length))
                sequences += count
            each = left // length
            full = min(count, n // each)
            rest = min(n - full * each, each - 1) if full < count else 0
            taken = full * each + rest
            plan.append((length, rank, rank + taken, first, each, capacity - left))
            put(left - each * length, first, full)
            if rest:
                put(left - rest * length, first + full, 1)
            put(left, first + full + bool(rest), count - full - bool(rest))
            rank, n = rank + taken, n - taken
    return plan


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id))
    counts = stored(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # <= capacity rows
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), PLAN_SCHEMA)
    # One row per task and length: the pieces of that length in earlier tasks.
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    earlier = counts.select("task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(earlier, ["task", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    # The plan has rows for lengths and rooms up to the capacity, not for pieces.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length"))
                         & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    inside = F.col("_rank") - F.col("rank_from")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.floor(inside / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("place") + (inside % F.col("per_sequence")) * F.col("length")).alias("offset"))
