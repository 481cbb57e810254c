"""Principal directions and token embeddings without a square matrix on the driver.

Directions come from randomised block power iteration: a block of ``k + spare`` vectors is
multiplied by the Gram matrix of the rows, part by part, and made orthonormal again. What the
driver holds and sends out is the block, width x (k + spare) numbers, and never a matrix of
width x width. Rows are dense arrays or sorted positions with values; sparse rows stay sparse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionloom.operators.ordering import ordered_codes
from actionloom.operators.windows import attach
from actionloom.session import stored
from actionloom.spec import SAMPLE_SEED

SPARE, ROUNDS = 10, 6
#: Partial sums are added up in so many groups before they meet in one.
_GROUPS = 256
#: Rows that are multiplied together in a task.
_SLICE = 4096


@dataclass(frozen=True)
class Factors:
    """``directions`` (width, k) by falling ``variance``; ``share`` of the whole variance; ``mean``."""

    directions: np.ndarray
    variance: np.ndarray
    share: np.ndarray
    mean: np.ndarray

    def reaching(self, ratio: float) -> int:
        """The fewest directions that hold ``ratio`` of the variance; all of them if none do."""
        return min(int(np.searchsorted(np.cumsum(self.share), ratio - 1e-12)) + 1, len(self.share))


def sparse_rows(df: DataFrame, codes: str, *keep: str) -> DataFrame:
    """``keep`` and the row of ones at the positions in ``codes`` (an array without repeats)."""
    return df.select(*keep, F.coalesce(F.col(codes).cast("array<int>"), F.array().cast("array<int>")).alias("at"),
                     F.coalesce(F.transform(codes, lambda _: F.lit(1.0)), F.array().cast("array<double>")).alias("value"))


def dense_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """``keep`` and the rows of an array column, as positions and values; a null array is zeros."""
    values = F.coalesce(F.col(column).cast("array<double>"), F.array().cast("array<double>"))
    return df.select(*keep, F.transform(values, lambda _, i: i).alias("at"), values.alias("value"))


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, value) of every entry of a batch."""
    lists = batch.column("at")
    lengths = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), lengths), lists.flatten().to_numpy(), batch.column("value").flatten().to_numpy()


def _times(batch: pa.RecordBatch, block: np.ndarray) -> np.ndarray:
    """The rows of a batch times a block of vectors."""
    row, at, value = entries(batch)
    out = np.zeros((batch.num_rows, block.shape[1]))
    np.add.at(out, row, value[:, None] * block[at])
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            yield batch.slice(start, _SLICE)


def summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray | tuple[np.ndarray, np.ndarray]],
           size: int) -> np.ndarray:
    """The sum over all rows of ``partial``, which gives ``size`` numbers for a batch, or
    different places among so many and the numbers there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in _slices(batches):
            found = partial(part)
            if isinstance(found, tuple):
                total[found[0]] += found[1]
            else:
                total += found
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % _GROUPS], pa.int32()),
             pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(total))], names=["part", "sums"])

    parts = rows.mapInArrow(run, "part int, sums array<double>").withColumn("sums", array_to_vector("sums"))
    groups = parts.groupBy("part").agg(Summarizer.sum(F.col("sums")).alias("sums"))
    # Grouped by a constant, as a sum of no vectors at all is an error.
    whole = groups.withColumn("all", F.lit(True)).groupBy("all").agg(vector_to_array(Summarizer.sum(F.col("sums"))).alias("sums")).first()
    return np.array(whole["sums"]) if whole else np.zeros(size)


def factorise(rows: DataFrame, width: int, k: int, centre: bool = True, spare: int = SPARE, rounds: int = ROUNDS,
              seed: int = SAMPLE_SEED) -> Factors:
    """The ``k`` strongest directions of ``rows`` (columns at, value), about their mean or about 0.

    One pass for the means and the whole variance and one for each round; give it a stored
    table. Directions are exact up to the gap to what is left out, to the power of ``rounds``;
    the sign of each makes its largest entry positive. A width of 0 or no row gives none.
    """
    context = rows.sparkSession.sparkContext
    rows = rows.select("at", "value")
    k = min(k, width)
    if not k:
        return Factors(np.zeros((width, 0)), np.zeros(0), np.zeros(0), np.zeros(width))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        _, at, value = entries(batch)
        return np.concatenate((np.bincount(at, value, width), [batch.num_rows, float(value @ value)]))

    sums = summed(rows, moments, width + 2)
    count, squares = sums[width], sums[width + 1]
    mean = sums[:width] / max(count, 1) if centre else np.zeros(width)
    freedom = max(count - 1, 1) if centre else max(count, 1)
    whole = (squares - count * float(mean @ mean)) / freedom
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(k + spare, width))))[0]

    def gram(block: np.ndarray) -> np.ndarray:
        sent = context.broadcast(block)  # width x (k + spare) numbers

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            row, at, value = entries(batch)
            out = np.zeros(sent.value.shape)
            np.add.at(out, at, value[:, None] * _times(batch, sent.value)[row])
            return out.ravel()

        product = summed(rows, partial, block.size).reshape(block.shape)
        sent.unpersist()
        return (product - count * np.outer(mean, mean @ block)) / freedom

    for _ in range(rounds):
        block = np.linalg.qr(gram(block))[0]
    inner = block.T @ gram(block)
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:k]
    directions, variance = block @ turns[:, order], np.maximum(values[order], 0)
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(k)])
    return Factors(directions, variance, variance / whole if whole > 0 else np.zeros(k), mean)


def project(rows: DataFrame, factors: Factors, k: int | None = None, out: str = "reduced") -> DataFrame:
    """The other columns of ``rows`` and the ``k`` first coordinates, in one pass."""
    directions = factors.directions[:, :k]
    sent = rows.sparkSession.sparkContext.broadcast((directions, factors.mean @ directions))
    kept = [c for c in rows.columns if c not in ("at", "value")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, shift = sent.value
        for part in _slices(batches):
            found = _times(part, block) - shift
            ends = pa.array(np.arange(part.num_rows + 1) * block.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[*kept, out])

    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.DoubleType()))])
    return rows.select(*kept, "at", "value").mapInArrow(run, schema)


def factorise_to(rows: DataFrame, width: int, ratio: float, first: int = 16, **settings) -> tuple[Factors, int]:
    """Factors that hold ``ratio`` of the variance, and how many are needed; blocks double until they do."""
    k = min(first, width)
    while True:
        found = factorise(rows, width, k, **settings)
        if k >= width or found.share.sum() >= ratio:
            return found, found.reaching(ratio) if len(found.share) else 0
        k = min(2 * k, width)


# Embeddings of tokens that stand near each other in lists.

WINDOW = 5


def positive_pmi(df: DataFrame, column: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """((code_a, code_b, ppmi) of both orders, (token, code)), stored.

    Two places of a list at most ``window`` apart are one co-occurrence. Positive pointwise
    mutual information is ln of how much more often two tokens meet than their totals would
    have it, where that is above 0. Lists are never paired whole: a list of any length gives
    ``window`` pairs a place, and pairs are added up before they are moved.
    """
    lists = df.select(F.col(column).alias("tokens")).filter(F.size(column) > 0)
    tokens = lists.select(F.explode("tokens").alias("token"))
    vocabulary = stored(ordered_codes(tokens, "token"))
    near = lists.select("tokens", F.posexplode("tokens").alias("i", "a")).select(
        "a", F.explode(F.slice("tokens", F.col("i") + 2, F.lit(window))).alias("b"))
    counted = near.filter("a IS NOT NULL AND b IS NOT NULL").groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # Both orders: a token met with itself counts twice, as two places do.
    both = counted.select("a", "b", "n").union(counted.select(F.col("b"), F.col("a"), "n")).groupBy("a", "b").agg(
        F.sum("n").alias("n"))
    both = stored(both)
    totals = both.groupBy("a").agg(F.sum("n").alias("total"))
    whole = both.agg(F.sum("n").alias("whole")).scalar()
    code = lambda side: vocabulary.select(F.col("token").alias(side), F.col("code").alias(f"code_{side}"))
    measured = (
        both.join(totals, "a").join(totals.withColumnsRenamed({"a": "b", "total": "total_b"}), "b")
        .withColumn("ppmi", F.log(F.col("n").cast("double") * whole / (F.col("total").cast("double") * F.col("total_b"))))
        .filter("ppmi > 0").join(code("a"), "a").join(code("b"), "b").select("code_a", "code_b", "ppmi"))
    return stored(measured), vocabulary


def token_embeddings(df: DataFrame, column: str, size: int, window: int = WINDOW, seed: int = SAMPLE_SEED,
                     rounds: int = ROUNDS) -> DataFrame:
    """(token, embedding of ``size`` numbers) for every token of the list column.

    The matrix of positive mutual information is factorised; a token's numbers are its row's
    coordinates over the root of the singular values. Tokens that nothing goes with have zeros,
    and so have the numbers beyond the size of the vocabulary. The vocabulary is never collected.
    """
    pairs, vocabulary = positive_pmi(df, column, window)
    width = vocabulary.count()
    entries = F.array_sort(F.collect_list(F.struct(F.col("code_b").cast("int").alias("at"), F.col("ppmi").alias("value"))))
    rows = stored(pairs.groupBy("code_a").agg(entries.alias("e")).select(
        "code_a", F.col("e.at").alias("at"), F.col("e.value").alias("value")))
    # No centring, and sums instead of means: the variance is the square of the singular value.
    found = factorise(rows, width, size, centre=False, seed=seed, rounds=rounds)
    count = rows.count()
    roots = np.sqrt(np.sqrt(found.variance * max(count, 1)))
    scaled = Factors(found.directions / np.where(roots > 1e-9, roots, np.inf), found.variance, found.share, found.mean)
    placed = project(rows, scaled, out="embedding")
    zeros = F.array_repeat(F.lit(0.0), size)
    padded = F.slice(F.concat(F.coalesce("embedding", F.array().cast("array<double>")), zeros), 1, size)
    return vocabulary.join(placed, vocabulary["code"] == placed["code_a"], "left").select("token", padded.alias("embedding"))


def list_embeddings(df: DataFrame, id_column: str, column: str, size: int, window: int = WINDOW,
                    out: str = "embedding") -> DataFrame:
    """(id, mean embedding of the list's tokens); an empty list has zeros."""
    lists = df.select(id_column, column)
    vectors = token_embeddings(lists, column, size, window)
    tokens = lists.select(id_column, F.explode(column).alias("token"))
    means = [F.avg(F.get("embedding", F.lit(i))).alias(f"_{i}") for i in range(size)]
    averaged = attach(tokens, vectors, ["token"]).groupBy(id_column).agg(*means).select(
        id_column, F.array(*[f"_{i}" for i in range(size)]).alias(out))
    ids = lists.select(id_column).distinct()
    return attach(ids, averaged, [id_column]).withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0.0), size)))
