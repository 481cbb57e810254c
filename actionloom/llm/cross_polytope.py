"""Approximate nearest neighbours by cosine, with cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit
vector; its hash is the signed axis it is then nearest to. Every vector is entered under
one hash per table. A query asks each table under several hashes, its next nearest axes,
and the vectors met there are ranked by their exact cosine in double precision. The fewer
vectors there are, the more axes are asked, up to all of them: then every vector is met.

Equal vectors are hashed once: only the ``k + 1`` smallest ids of each can appear in a
result. Candidates are dealt to blocks by their id and queries to parts; a block meets a part
in one task, which finds the shared buckets itself. So a vector is moved once for each part of
queries and not once for each table, no bucket is hot, and what a task holds is bounded by
bytes. What leaves it is at most k + 1 rows per query.

Defined results: vectors that are null, zero, of another length than ``dimension`` or hold
null or non-finite components take no part, neither as queries nor as candidates. Repeated
ids are ranked as often as their vectors differ. Ties go to the smaller id. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actionloom.session import stored

ROUNDS = 3
#: Bytes of the vectors of a block, or of a part of queries, and pairs that are compared at a time.
_BYTES, _PAIRS = 1 << 25, 1 << 18


@dataclass(frozen=True)
class Settings:
    """Tables, least probes per table, vectors to meet per table, and the fewest vectors worth a block."""

    tables: int = 16
    probes: int = 5
    meet: int = 64
    part_vectors: int = 2000
    seed: int = 42


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def _padded(dimension: int) -> int:
    return 1 << max(0, (dimension - 1).bit_length())


def _signs(settings: Settings, width: int) -> np.ndarray:
    draw = np.random.default_rng(settings.seed)
    return draw.choice([-1.0, 1.0], size=(settings.tables, ROUNDS, width))


def nearest_axes(vectors: np.ndarray, settings: Settings, axes: int) -> np.ndarray:
    """(rows, tables, axes): the signed axes nearest to each turned vector, nearest first; at most all."""
    width = _padded(vectors.shape[1])
    axes = min(axes, 2 * width)
    unit = np.zeros((len(vectors), width))
    unit[:, :vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = np.empty((len(vectors), settings.tables, axes), np.int32)
    for table, rounds in enumerate(_signs(settings, width)):
        turned = unit
        for signs in rounds:
            turned = hadamard(turned * signs)
        both = np.concatenate((turned, -turned), axis=1)
        near = np.argpartition(-both, axes - 1, axis=1)[:, :axes]
        order = np.argsort(-np.take_along_axis(both, near, axis=1), axis=1, kind="stable")
        found[:, table] = np.take_along_axis(near, order, axis=1)
    return found


def usable(vector: str, dimension: int) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _probes(vectors: DataFrame, settings: Settings, dimension: int, axes: int) -> DataFrame:
    """``vectors`` and ``_cells``, the axes asked in each table, one table after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = nearest_axes(_matrix(part.column(1), dimension), settings, axes)
                lists = pa.ListArray.from_arrays(
                    np.arange(len(found) + 1, dtype=np.int32) * found[0].size, pa.array(found.reshape(-1), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["_rep", "_v", "_cells"])

    kind = vectors.schema["_v"].dataType.simpleString()
    return vectors.select("_rep", "_v").mapInArrow(run, f"_rep long, _v {kind}, _cells array<int>")


def _cosines(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact cosine of each pair of rows."""
    parts = [(q[i] * c[j]).sum(axis=1) / (np.linalg.norm(q[i], axis=1) * np.linalg.norm(c[j], axis=1))
             for i, j in ((a[s:s + _PAIRS], b[s:s + _PAIRS]) for s in range(0, len(a), _PAIRS))]
    return np.concatenate(parts) if parts else np.empty(0)


def _best(q: np.ndarray, probed: np.ndarray, c: np.ndarray, cells: np.ndarray, ids: np.ndarray,
          k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of the k + 1 best ids that each query meets in a bucket.

    ``probed`` is (queries, tables, axes), ``cells`` is (candidates, tables). Ties go to the smaller id.
    """
    unit_q, unit_c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, c))
    # As many rows as may stand before the k + 1 best ids are complete: an id may have several vectors.
    wanted = (k + 1) * int(np.unique(ids, return_counts=True)[1].max())
    bar = np.full(len(q), -np.inf)
    found: list[tuple[np.ndarray, ...]] = []
    held = 0

    def compact() -> None:
        nonlocal held
        a, b, s = (np.concatenate(x) for x in zip(*found))
        near = s >= bar[a]
        pairs = np.unique(a[near].astype(np.int64) * len(c) + b[near])
        a, b = pairs // len(c), pairs % len(c)
        exact = _cosines(q, c, a, b)
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        # Only the best vector of an id counts, then the first k + 1 ids of a query.
        seen = np.lexsort((np.arange(len(a)), ids[b], a))
        first = np.ones(len(a), bool)
        first[seen[1:]] = (a[seen[1:]] != a[seen[:-1]]) | (ids[b[seen[1:]]] != ids[b[seen[:-1]]])
        a, b, exact = a[first], b[first], exact[first]
        few = np.arange(len(a)) - np.searchsorted(a, a) <= k
        found[:] = [(a[few], b[few], exact[few])]
        held = len(found[0][0])

    for table in range(cells.shape[1]):
        by_cell, asks = np.argsort(cells[:, table], kind="stable"), probed[:, table].ravel()
        by_ask = np.argsort(asks, kind="stable")
        at, asked = cells[by_cell, table], asks[by_ask]
        for cell in np.intersect1d(at, asked):
            there = by_cell[np.searchsorted(at, cell):np.searchsorted(at, cell, "right")]
            rows = by_ask[np.searchsorted(asked, cell):np.searchsorted(asked, cell, "right")] // probed.shape[2]
            last, met, step = min(wanted, len(there)), unit_c[there].T, max(1, _PAIRS // len(there))
            for start in range(0, len(rows), step):
                block = rows[start:start + step]
                s = unit_q[block] @ met
                if last == wanted:
                    # A little below the last, so that rounding in this step drops no tie.
                    bar[block] = np.maximum(bar[block], np.partition(s, -last, axis=1)[:, -last] - 1e-9)
                i, j = np.nonzero(s >= bar[block, None])
                found.append((block[i], there[j], s[i, j]))
                held += len(i)
                if held > 8 * _PAIRS + (k + 1) * len(q):
                    compact()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    compact()
    return found[0]


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
               vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for every query but itself."""
    # Vectors of single precision are moved as such; all arithmetic is in double precision.
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    named = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast(f"array<{number}>").alias("_v"),
                           F.coalesce(is_query, F.lit(False)).alias("_query"))
    sized = named.filter(F.col("_id").isNotNull() & (F.size("_v") > 0))
    first = sized.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = first["d"] if first else 1
    # Adding zero makes a negative zero a plain one, so that equal vectors are equal arrays.
    valid = sized.filter(usable("_v", dimension)).withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0).cast(number)))
    # Equal vectors: a limit per vector that Spark applies before the exchange.
    place = F.row_number().over(W.partitionBy("_v").orderBy("_id"))
    kept = stored(valid.withColumn("_place", place).filter(F.col("_place") <= k + 1)
                  .withColumn("_rep", F.min("_id").over(W.partitionBy("_v"))).select("_id", "_rep", "_v", "_place"))
    # No join on the vectors: a wide table must not be broadcast because its file is small.
    same = W.partitionBy("_v")
    queries = stored(valid.filter("_query").withColumn("_asked", F.min("_id").over(same)).withColumn(
        "_place", F.row_number().over(same.orderBy("_id"))).select("_id", "_asked", "_v", "_place"))
    candidates, asked = kept.filter("_place = 1").select("_rep", "_v"), queries.filter("_place = 1")
    queries, asked = queries.select("_id", "_asked"), asked.select(F.col("_asked").alias("_rep"), "_v")
    distinct_vectors, questions = candidates.count(), asked.count()

    most = max(1, _BYTES // (8 * dimension))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(distinct_vectors / most), min(4 * cores, math.ceil(distinct_vectors / settings.part_vectors)))
    parts = max(1, math.ceil(questions / most))
    axes = max(settings.probes, math.ceil(2 * _padded(dimension) * settings.meet / max(1, distinct_vectors)))
    dealt = lambda n: F.pmod(F.xxhash64("_rep"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    offered = candidates.select(dealt(blocks).alias("_block"), every(parts).alias("_part"), "_rep", "_v",
                                F.lit(None).cast("array<int>").alias("_cells"))
    asking = stored(_probes(asked, settings, dimension, axes))
    visits = asking.select(every(blocks).alias("_block"), dealt(parts).alias("_part"), "_rep", "_v", "_cells")

    def rank(group: pa.Table) -> pa.Table:
        asks = pc.is_valid(group.column("_cells")).combine_chunks()
        met, asked = group.filter(pc.invert(asks)), group.filter(asks)
        if not met.num_rows or not asked.num_rows:
            a = b = np.empty(0, np.int64)
            exact = np.empty(0)
        else:
            q, c = (_matrix(t.column("_v").combine_chunks(), dimension) for t in (asked, met))
            probed = asked.column("_cells").combine_chunks().flatten().to_numpy().reshape(len(q), settings.tables, -1)
            cells = np.concatenate([nearest_axes(c[s:s + 1024], settings, 1)[:, :, 0] for s in range(0, len(c), 1024)])
            a, b, exact = _best(q, probed, c, cells, met.column("_rep").to_numpy(), k)
        return pa.Table.from_arrays(
            [asked.column("_rep").combine_chunks().take(pa.array(a)),
             met.column("_rep").combine_chunks().take(pa.array(b)), pa.array(exact, pa.float64())],
            names=["_asked", "_rep", "score"])

    met = offered.unionByName(visits).groupBy("_block", "_part").applyInArrow(rank, "_asked long, _rep long, score double")
    distinct = met.groupBy("_asked", "_rep").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("_rep")]
    few = distinct.withColumn("_r", F.row_number().over(W.partitionBy("_asked").orderBy(*order))).filter(
        F.col("_r") <= k + 1)
    # At most k + 1 vectors per query, each with at most k + 1 ids.
    expanded = few.join(kept.select("_id", "_rep"), "_rep").select("_asked", F.col("_id").alias(id_col), "score")
    paired = queries.withColumnRenamed("_id", "query_id").join(expanded, "_asked").filter(F.col(id_col) != F.col("query_id"))
    final = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col)))
    return paired.withColumn("rank", final).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
