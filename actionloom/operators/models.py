"""Per-action classifiers, their predictions and ensembles, on ``pyspark.ml``.

A fit takes a prepared frame with a ``features`` vector and returns a model; the frame is
prepared once and shared by all actions. Fits are distributed; the loops over actions and
folds only submit them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import (
    FMClassificationModel, FMClassifier, GBTClassificationModel, GBTClassifier, LogisticRegression,
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actionloom.functions.vectors import sparse_struct, stored_vectors
from actionloom.operators.evaluate import group_auc
from actionloom.operators.factors import entries, summed
from actionloom.operators.ordering import ordered_codes
from actionloom.operators.windows import attach
from actionloom.session import discard, stored
from actionloom.spec import SAMPLE_SEED, FeatureSpec

T = TypeVar("T")
Fit = Callable[[DataFrame, str], Model]
#: A label, and which rows are fitted, None for all of them.
FitJob = tuple[str, Column | None]


def dense_features(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Columns as one vector; missing numbers must be filled before."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def filled_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Array columns as vectors for an assembler, missing ones all zeros. Reads the widths first."""
    if not columns:
        return df
    widths = df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in columns]).first()
    zeros = {c: F.array_repeat(F.lit(0.0), max(0, widths[c])) for c in columns}
    return df.withColumns({c: array_to_vector(F.coalesce(F.col(c).cast("array<double>"), zeros[c])) for c in columns})


def mixed_features(df: DataFrame, ids: Sequence[str], dense: Sequence[str], vectors: Sequence[str] = (),
                   buckets: int = 1 << 18, out: str = "features") -> DataFrame:
    """Ids hashed to a fixed number of indicator positions, next to dense columns and
    array columns.

    There is no id dictionary to collect, so the size on the driver does not grow with
    the number of users or items.
    """
    # Text values are categories to the hasher; the name keeps equal ids of two columns apart.
    texts = df.withColumns({f"_id_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids})
    hashed = FeatureHasher(
        inputCols=[f"_id_{c}" for c in ids], outputCol="_hashed", numFeatures=buckets
    ).transform(texts)
    hashed = hashed.withColumns({f"_vector_{c}": array_to_vector(F.col(c)) for c in vectors}) if vectors else hashed
    parts = ["_hashed", *dense, *[f"_vector_{c}" for c in vectors]]
    assembled = VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="error").transform(hashed)
    return assembled.drop("_hashed", *[f"_id_{c}" for c in ids], *[f"_vector_{c}" for c in vectors])


@dataclass(frozen=True)
class IdSlots:
    """Where each id of each column stands: ``codes`` (value, code) per column, from the slot
    ``first`` on, which is that of unknown ids; ``width`` slots altogether."""

    codes: dict[str, DataFrame]
    first: dict[str, int]
    width: int


def fit_id_slots(df: DataFrame, ids: Sequence[str]) -> IdSlots:
    """A slot of its own for every id of every column, none shared. Counts reach the driver, ids do not."""
    codes, first, width = {}, {}, 0
    for c in ids:
        codes[c] = stored(ordered_codes(df, c, "_code"))
        first[c] = width
        width += codes[c].count() + 1
    return IdSlots(codes, first, width)


def slot_features(df: DataFrame, slots: IdSlots, dense: Sequence[str] = (), vectors: Mapping[str, int] | None = None,
                  out: str = "features") -> DataFrame:
    """``df``, stored, with the ids as indicators next to dense columns and array columns.

    ``vectors`` gives the width of each array column. Ids that were not there when the slots
    were fitted, and missing ones, share the unknown slot of their column.
    """
    places, values, width = [], [], slots.width
    for c, codes in slots.codes.items():
        df = attach(df, codes.withColumnRenamed("_code", f"_slot_{c}"), [c])
        places.append(F.lit(slots.first[c]) + F.coalesce(F.col(f"_slot_{c}") + 1, F.lit(0)))
        values.append(F.lit(1.0))
    for c in dense:
        places.append(F.lit(width).cast("long"))
        values.append(F.col(c).cast("double"))
        width += 1
    at, value = F.array(*places), F.array(*values)
    for c, n in (vectors or {}).items():
        at = F.concat(at, F.sequence(F.lit(width).cast("long"), F.lit(width + n - 1).cast("long")))
        value = F.concat(value, F.col(c).cast("array<double>"))
        width += n
    named = df.withColumn(out, sparse_struct(width, at, value)).drop(*[f"_slot_{c}" for c in slots.codes])
    return stored_vectors(named, out)


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("_label", F.col(label).cast("double"))


#: Rows that a task of a fit holds at most, and rows that are few enough to be fitted as they lie.
ROWS_PER_TASK, FEW_ROWS = 1 << 18, 1 << 16


@contextmanager
def dealt(train: DataFrame) -> Iterator[DataFrame]:
    """``train`` for the fits inside, in even parts on the executors' disks, as many as fill waves of tasks.

    A fit keeps its rows as they are read. A file of repeated values is far smaller than its rows,
    so that splits by bytes give few tasks, uneven and as large as the input. The rows are
    moved once for all fits; give only columns that fits read, and read it inside only.
    """
    size = train.count()
    if size <= FEW_ROWS:
        yield train
        return
    cores = train.sparkSession.sparkContext.defaultParallelism
    kept = train.repartition(cores * math.ceil(size / (cores * ROWS_PER_TASK))).persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


#: Rows up to which one fit leaves cores idle, and how many such fits run at once.
SHARED_ROWS, SHARED_FITS = 1 << 20, 4


def side_by_side(train: DataFrame, tasks: Sequence[Callable[[], T]]) -> list[T]:
    """The results of ``tasks``, which are fits of ``train``: some at a time while one is too small for all
    cores, one after the other beyond that, as each keeps its own copy of the rows."""
    if len(tasks) < 2 or train.count() > SHARED_ROWS:
        return [task() for task in tasks]
    with ThreadPoolExecutor(min(SHARED_FITS, len(tasks))) as pool:
        return list(pool.map(lambda task: task(), tasks))


def _gbt(max_iter: int, **params) -> GBTClassifier:
    settings = dict(
        labelCol="_label", featuresCol="features", stepSize=0.05, maxDepth=6, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", seed=SAMPLE_SEED, maxMemoryInMB=512,
    )
    return GBTClassifier(maxIter=max_iter, **{**settings, **params})


def best_length(losses: Sequence[float], patience: int) -> int:
    """How many rounds to keep: the best so far once ``patience`` rounds bring nothing better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def leaf_values(model: Model) -> list[list[float]]:
    """Per tree, what each leaf adds to the margin; leaves are numbered from left to right."""
    def leaves(node) -> list[float]:
        found, waiting = [], [node]
        while waiting:
            at = waiting.pop()
            if at.subtreeDepth():
                waiting += [at.rightChild(), at.leftChild()]
            else:
                found.append(at.prediction())
        return found

    return [[w * v for v in leaves(tree.rootNode())] for tree, w in zip(model._java_obj.trees(), model.treeWeights)]


def prefix_margins(model: Model, df: DataFrame, lengths: Sequence[int], out: str = "margins") -> DataFrame:
    """Add the margins that the first ``lengths`` trees give, as one array.

    The model tells each row's leaf in every tree, all trees in one pass; the margins are
    sums of the leaves' values. ``lengths`` ascend; their number is the length of the array.
    """
    values = "array(" + ", ".join(
        "array(" + ", ".join(f"{v!r}D" for v in tree) + ")" for tree in leaf_values(model)) + ")"
    leaves = model.transform(df, {model.leafCol: "_leaves"}).withColumn("_leaves", vector_to_array("_leaves"))
    added = F.expr(f"transform(_leaves, (leaf, tree) -> get(get({values}, tree), cast(leaf AS int)))")
    cuts = list(zip([0, *lengths], lengths))
    steps = "array(" + ", ".join(
        f"aggregate(slice(_added, {a + 1}, {b - a}), 0D, (x, y) -> x + y)" for a, b in cuts) + ")"
    running = f"aggregate({steps}, array(0D), (sums, x) -> array_append(sums, element_at(sums, -1) + x))"
    return leaves.withColumn("_added", added).withColumn(out, F.expr(f"slice({running}, 2, {len(cuts)})")).drop(
        "_leaves", "_added", "rawPrediction", "probability", "prediction")


def prefix_uauc(model: Model, df: DataFrame, label: str, user: str = "userid",
                lengths: Sequence[int] | None = None) -> DataFrame:
    """(trees, users, uauc): mean per-user AUC of the first so many trees, all in one pass.

    Margins rank rows as probabilities do. ``lengths`` defaults to every number of trees.
    """
    lengths = list(lengths) if lengths is not None else list(range(1, model.getNumTrees + 1))
    margins = prefix_margins(model, df.select(user, label, model.getFeaturesCol()), lengths)
    trees = F.array(*[F.lit(n) for n in lengths])
    long = margins.select(
        user, F.col(label).cast("int").alias("label"),
        F.inline(F.zip_with(trees, "margins", lambda n, m: F.struct(n.alias("trees"), m.alias("score")))))
    per_user = group_auc(long, [user, "trees"], decimals=None)
    return per_user.groupBy("trees").agg(F.count("auc").alias("users"), F.avg("auc").alias("uauc"))


def first_trees(model: Model, n: int) -> Model:
    """The model of the first ``n`` trees; nothing is fitted again."""
    context = SparkContext.getOrCreate()  # a thread of its own may have no active session
    ml, new_array = context._jvm.org.apache.spark.ml, context._gateway.new_array
    trees = new_array(ml.regression.DecisionTreeRegressionModel, n)
    weights = new_array(context._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(model._java_obj.trees())[:n], model.treeWeights)):
        trees[i], weights[i] = tree, weight
    java = ml.classification.GBTClassificationModel(model.uid, trees, weights)
    return model._copyValues(GBTClassificationModel(java))


def fit_gbt_early_stop(train: DataFrame, label: str, spec: FeatureSpec, max_iter: int = 100,
                       patience: int = 20, measure: str = "uauc", every: int = 1, **params) -> tuple[Model, int]:
    """(boosted trees of the days before validation, rounds), with the rounds that served
    the validation day best; single rounds without a gain do not end the search.

    ``measure`` is "uauc", the mean AUC of a user, or "logloss". One fit of ``max_iter``
    trees, one pass of the validation day for all lengths that are multiples of ``every``, and
    the model's first trees. Without a user of both classes on that day no length is better
    than another, and one step is kept.
    """
    rows = _labelled(train, label)
    validation = rows.filter(F.col(spec.day) == spec.validation_day)
    longest = _gbt(max_iter, **params).fit(rows.filter(F.col(spec.day) != spec.validation_day))
    grown = longest.getNumTrees
    if measure == "logloss":
        lengths = list(range(1, grown + 1))
        losses = longest.evaluateEachIteration(validation)
    elif measure == "uauc":
        lengths = [*range(every, grown, every), grown]
        found = {r["trees"]: r["uauc"] for r in prefix_uauc(longest, validation, label, spec.user, lengths).collect()}
        losses = [math.inf if found.get(n) is None else -found[n] for n in lengths]
    else:
        raise ValueError("measure must be uauc or logloss")
    rounds = lengths[best_length(losses, max(1, patience // every) if measure == "uauc" else patience) - 1]
    return (longest if rounds == grown else first_trees(longest, rounds)), rounds


def fit_gbt(train: DataFrame, label: str, max_iter: int, **params) -> Model:
    return _gbt(max_iter, **params).fit(_labelled(train, label))


def fit_gbt_refit(train: DataFrame, label: str, spec: FeatureSpec, max_iter: int = 100, **params) -> tuple[Model, Model]:
    """(the early-stopped model, a model of as many trees fitted on all rows)."""
    stopped, rounds = fit_gbt_early_stop(train, label, spec, max_iter, **params)
    return stopped, fit_gbt(train, label, rounds, **params)


def fit_gbt_weighted(train: DataFrame, label: str, max_iter: int = 200, **params) -> Model:
    """Boosted trees with the classes weighted to equal mass."""
    rows = _labelled(train, label)
    mass = rows.agg(
        F.count_if(F.col("_label") == 0).alias("neg"), F.count_if(F.col("_label") == 1).alias("pos")
    ).select((F.col("neg") / F.greatest(F.col("pos"), F.lit(1))).alias("w")).scalar()
    weighted = rows.withColumn("_mass", mass).withColumn(
        "_weight", F.when(F.col("_label") == 1, F.col("_mass")).otherwise(F.lit(1.0))
    )
    settings = dict(weightCol="_weight", maxDepth=7, minInstancesPerNode=15, maxBins=200)
    return _gbt(max_iter, **{**settings, **params}).fit(weighted)


def _gaussians(n: int, seed: int) -> np.ndarray:
    """The first ``n`` normal numbers that ``java.util.Random`` draws from ``seed``, as the trainer's start does."""
    mask, steps = np.uint64((1 << 48) - 1), 4 * n + 256
    while True:
        states = np.array([((seed ^ 0x5DEECE66D) * 0x5DEECE66D + 11) & int(mask)], np.uint64)
        factor, shift = 0x5DEECE66D, 11
        while len(states) < steps:  # twice as many at a time: the step over all states so far is linear too
            states = np.concatenate((states, (states * np.uint64(factor) + np.uint64(shift)) & mask))
            factor, shift = factor * factor & int(mask), shift * (factor + 1) & int(mask)
        high, low = states[:steps:2] >> np.uint64(22), states[1:steps:2] >> np.uint64(21)
        uniform = 2 * ((high << np.uint64(27)) + low).astype(float) * 2.0 ** -53 - 1
        x, y = uniform[0::2], uniform[1::2]
        s = x * x + y * y
        inside = (s < 1) & (s > 0)
        if 2 * inside.sum() >= n:
            scale = np.sqrt(-2 * np.log(s[inside]) / s[inside])
            return np.stack((x[inside] * scale, y[inside] * scale), 1).ravel()[:n]
        steps *= 2


def _fm_often(rows: DataFrame, width: int) -> np.ndarray:
    """The places that a quarter of the rows or more have an entry at."""
    def seen(batch: pa.RecordBatch) -> np.ndarray:
        return np.append(np.bincount(entries(batch)[1], minlength=width), batch.num_rows).astype(float)

    counts = summed(rows, seen, width + 1)
    return np.flatnonzero((counts[:-1] > 0) & (4 * counts[:-1] >= counts[-1]))


def _fm_rows(train: DataFrame, jobs: Sequence[FitJob], features: str, width: int) -> tuple[DataFrame, np.ndarray]:
    """(dense, at, value, label) of every row, stored in pieces for all cores, and the places of ``dense``.

    Entries at places that many rows have stand in an array, the others as places and values. ``label`` has a number
    for each job, -1 where the job leaves the row out.
    """
    bare = F.col("_entries")
    finite = ~F.exists(bare["values"], lambda x: ~(F.abs(x) < float("inf")))
    places = F.when(F.size(bare["values"]) > 0, F.sequence(F.lit(0), F.size(bare["values"]) - 1))
    wrong = F.raise_error("labels must be 0 or 1, features must be finite").cast("double")
    labels = []
    for i, (label, kept) in enumerate(jobs):
        train = train.withColumns({f"_label_{i}": F.col(label).cast("double"), f"_kept_{i}": F.lit(True) if kept is None else kept})
        known = F.when(F.col(f"_label_{i}").isin(0.0, 1.0) & finite, F.col(f"_label_{i}")).otherwise(wrong)
        labels.append(F.when(F.coalesce(f"_kept_{i}", F.lit(False)), known).otherwise(-1.0))
    own = [f"_{c}_{i}" for i in range(len(jobs)) for c in ("label", "kept")]
    rows = train.select(F.unwrap_udt(features).alias("_entries"), *own).select(
        F.coalesce(bare["indices"], places, F.array().cast("array<int>")).alias("at"),
        F.coalesce(bare["values"], F.array().cast("array<double>")).alias("value"), F.array(*labels).alias("label"))
    often = _fm_often(rows.select("at", "value"), width)
    column = np.full(width, -1)
    column[often] = np.arange(len(often))
    sent = train.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, value = entries(batch)
            n, size = batch.num_rows, int(sent.value.max(initial=-1)) + 1
            rare, dense = sent.value[at] < 0, np.zeros((n, size))
            dense[row[~rare], sent.value[at[~rare]]] = value[~rare]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row[rare], minlength=n))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(dense.ravel())),
                 pa.ListArray.from_arrays(ends, pa.array(at[rare], pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(value[rare])), batch.column("label")],
                names=["dense", "at", "value", "label"])

    dealt_rows = rows.repartition(2 * train.sparkSession.sparkContext.defaultParallelism)
    split = dealt_rows.mapInArrow(run, "dense array<double>, at array<int>, value array<double>, label array<double>")
    return stored(split), often


def _by_key(keys: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
    """The sums of the rows of ``values`` that have the same of ``length`` keys."""
    out = np.zeros((length, values.shape[1]))
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        out[keys[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _fm_sums(batch: pa.RecordBatch, intercept: float | np.ndarray, linear: np.ndarray, factors: np.ndarray,
             often: np.ndarray = np.empty(0, int)) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) over the rows of a batch: the gradients of factors, linear terms and intercept, the loss, the rows.

    Several models, in the first dimension of the parameters, are served at once; the places of one follow those of the
    other. Only features that occur have places, and those of ``often``, whose entries are the array ``dense``.
    """
    width, size = factors.shape[-2:]
    factors, linear = factors.reshape(-1, width, size), linear.reshape(-1, width)
    n, models = batch.num_rows, len(factors)
    row, at, value = entries(batch)
    held = np.unique(at)
    at = np.searchsorted(held, at)
    labels = batch.column("label")
    label = (labels.flatten() if pa.types.is_list(labels.type) else labels).to_numpy().reshape(n, models)
    used = label >= 0
    dense = batch.column("dense").flatten().to_numpy().reshape(n, len(often)) if len(often) else np.zeros((n, 0))
    squares = dense * dense

    # Linear terms stand beside the factors, so that each product is one pass of the matrix.
    def terms(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = factors[:, places].transpose(1, 0, 2)
        beside = np.concatenate((f, linear[:, places].T[:, :, None]), axis=2)
        return beside.reshape(len(places), models * (size + 1)), (f * f).sum(axis=2)

    (many, many_squares), (few, few_squares) = terms(often), terms(held)
    by_row = (dense @ many + _by_key(row, value[:, None] * few[at], n)).reshape(n, models, size + 1)
    own = squares @ many_squares + _by_key(row, (value * value)[:, None] * few_squares[at], n)
    raw = intercept + by_row[:, :, -1] + ((by_row[:, :, :-1] ** 2).sum(axis=2) - own) / 2
    with np.errstate(over="ignore"):
        pull = np.where(used, 1 / (1 + np.exp(-raw)) - label, 0.0)
    by_row[:, :, -1] = 1.0
    pulled = (by_row * pull[:, :, None]).reshape(n, models * (size + 1))
    slopes = np.concatenate((dense.T @ pulled, _by_key(at, value[:, None] * pulled[row], len(held))))
    owns = np.concatenate((squares.T @ pull, _by_key(at, (value * value)[:, None] * pull[row], len(held))))
    loss = np.where(used, np.logaddexp(0, np.where(label > 0, -raw, raw)), 0.0)
    at = np.concatenate((often, held))
    slopes = slopes.reshape(len(at), models, size + 1)
    length = width * (size + 1) + 3
    places = np.concatenate(((at[:, None] * size + np.arange(size)).ravel(), width * size + at, width * (size + 1) + np.arange(3)))
    sums = np.stack([np.concatenate((
        (slopes[:, m, :-1] - factors[m][at] * owns[:, m, None]).ravel(), slopes[:, m, -1],
        [pull[:, m].sum(), loss[:, m].sum(), used[:, m].sum()])) for m in range(models)])
    return (places + length * np.arange(models)[:, None]).ravel(), sums.ravel()


def fit_fm_together(train: DataFrame, jobs: Sequence[FitJob], **params) -> list[Model]:
    """A factorisation machine for each job, all from the same passes of the rows."""
    settings = dict(
        labelCol="_label", featuresCol="features", factorSize=8, solver="adamW", stepSize=0.05,
        regParam=1e-5, maxIter=30, seed=SAMPLE_SEED,
    )
    trainers = [FMClassifier(**{**settings, **params}) for _ in jobs]
    get = lambda name: trainers[0].getOrDefault(name)
    if get("solver") != "adamW" or get("miniBatchFraction") != 1.0 or not (get("fitLinear") and get("fitIntercept")):
        return [t.fit(_labelled(train if kept is None else train.filter(kept), label))
                for t, (label, kept) in zip(trainers, jobs, strict=True)]
    features, size = get("featuresCol"), get("factorSize")
    width = train.schema[features].metadata.get("ml_attr", {}).get("num_attrs") or train.select(features).first()[0].size
    (rows, often), context = _fm_rows(train, jobs, features, width), train.sparkSession.sparkContext
    start = np.concatenate((_gaussians(width * size, get("seed")) * get("initStd"), np.zeros(width + 1)))
    weights = np.tile(start, (len(jobs), 1))
    first, second = np.zeros(weights.shape), np.zeros(weights.shape)
    parts = lambda w: (w[:, -1], w[:, width * size:-1], w[:, :width * size].reshape(-1, width, size))
    going = np.full(len(jobs), True)
    for i in range(1, get("maxIter") + 1):
        sent = context.broadcast((*parts(weights), often))
        sums = summed(rows, lambda batch: _fm_sums(batch, *sent.value), weights.size + 2 * len(jobs)).reshape(len(jobs), -1)
        sent.unpersist()
        going &= sums[:, -1] > 0
        for m in np.flatnonzero(going):
            slope = sums[m, :-2] / sums[m, -1]
            first[m], second[m] = 0.9 * first[m] + 0.1 * slope, 0.999 * second[m] + 0.001 * slope * slope
            step = first[m] / (1 - 0.9 ** i) / (np.sqrt(second[m] / (1 - 0.999 ** i)) + 1e-8)
            after = weights[m] - get("stepSize") * step - get("regParam") * weights[m]
            going[m] = np.linalg.norm(weights[m] - after) >= get("tol") * max(np.linalg.norm(after), 1.0)
            weights[m] = after
        if not going.any():
            break
    discard(rows)

    def model(trainer: FMClassifier, intercept: float, linear: np.ndarray, factors: np.ndarray) -> Model:
        java = context._jvm.org.apache.spark.ml.classification.FMClassificationModel(
            trainer.uid, float(intercept), _py2java(context, Vectors.dense(linear)),
            _py2java(context, DenseMatrix(width, size, factors.ravel(), True)))
        return trainer._copyValues(FMClassificationModel(java))

    return [model(*job) for job in zip(trainers, *parts(weights), strict=True)]


def fit_fm(train: DataFrame, label: str, **params) -> Model:
    """Factorisation machine: linear terms and pairwise interactions of all features.

    The steps are those of ``FMClassifier`` with its solver adamW, from the same start. Its own gradient is a dense
    vector as long as the model for every row, so that time grows with rows times ids; here a row
    costs its entries, and a task gives one vector of sums.
    """
    return fit_fm_together(train, [(label, None)], **params)[0]


fit_fm.together = fit_fm_together


def fitted(train: DataFrame, jobs: Sequence[FitJob], fit: Fit) -> list[Model]:
    """The model of each job; a fit that can serve them all at once has ``together`` and is asked so."""
    if hasattr(fit, "together"):
        return fit.together(train, jobs)
    alone = lambda label, kept: fit(train if kept is None else train.filter(kept), label)
    return side_by_side(train, [partial(alone, *job) for job in jobs])


def _network_sums(batch: pa.RecordBatch, layers: Sequence[int], points: Mapping[int, np.ndarray], jobs: int) -> np.ndarray:
    """For each job its loss, its rows and its gradient at its point, over the rows of a batch; zeros without a point."""
    n = batch.num_rows
    x, labels = (batch.column(c).flatten().to_numpy().reshape(n, w) for c, w in (("x", layers[0]), ("label", jobs)))
    shapes = list(zip(layers, layers[1:]))
    out = np.zeros((jobs, 2 + sum((i + 1) * o for i, o in shapes)))
    for job, weights in points.items():
        rows = np.flatnonzero(labels[:, job] >= 0)
        label, active, parts, at = labels[rows, job].astype(int), [x[rows]], [], 0
        for i, o in shapes:
            # As the library lays them out: the matrix by columns, then the shift.
            parts.append(weights[at:at + i * o].reshape(i, o))
            z = active[-1] @ parts[-1] + weights[at + i * o:at + (i + 1) * o]
            at += (i + 1) * o
            with np.errstate(over="ignore"):
                active.append(1 / (1 + np.exp(-z)) if len(parts) < len(shapes) else z - z.max(axis=1, initial=-np.inf, keepdims=True))
        logs = active[-1] - np.log(np.exp(active[-1]).sum(axis=1, keepdims=True))
        out[job, :2] = -logs[np.arange(len(rows)), label].sum(), len(rows)
        pull = np.exp(logs)
        pull[np.arange(len(rows)), label] -= 1
        for (i, o), below, matrix in zip(shapes[::-1], active[-2::-1], parts[::-1]):
            at -= (i + 1) * o
            out[job, 2 + at:2 + at + (i + 1) * o] = np.concatenate(((below.T @ pull).ravel(), pull.sum(axis=0)))
            pull = (pull @ matrix.T) * below * (1 - below) if at else pull
    return out.ravel()


#: What a search asks for, and the loss and gradient it is given there.
_Asking = Generator[np.ndarray, tuple[float, np.ndarray], tuple[float, float, np.ndarray]]


def _wolfe(x: np.ndarray, loss: float, slope: np.ndarray, way: np.ndarray, step: float) -> _Asking:
    """(step, loss, gradient) that fulfil the strong Wolfe conditions along ``way``; a step of 0 if none is found."""
    start, tries = float(slope @ way), 10

    def at(t: float):
        value, gradient = yield x + t * way
        return t, value, float(gradient @ way), gradient

    def between(l, r) -> float:
        first = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        second = math.sqrt(max(first * first - l[2] * r[2], 0.0))
        down = r[2] - l[2] + 2 * second
        t = r[0] - (r[0] - l[0]) * (r[2] + second - first) / down if down else (l[0] + r[0]) / 2
        return min(max(t, l[0] + 0.1 * (r[0] - l[0])), l[0] + 0.9 * (r[0] - l[0]))

    def zoom(low, high):
        for _ in range(tries):
            c = yield from at(between(*sorted((low, high), key=lambda p: p[0])))
            if c[1] > loss + 1e-4 * c[0] * start or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(start):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return low

    low = (0.0, loss, start, slope)
    for i in range(tries):
        c = yield from at(step)
        if not math.isfinite(c[1]):
            step /= 2
            continue
        if c[1] > loss + 1e-4 * step * start or (c[1] >= low[1] and i):
            low = yield from zoom(low, c)
            break
        if abs(c[2]) <= 0.9 * abs(start):
            low = c
            break
        if c[2] >= 0:
            low = yield from zoom(c, low)
            break
        low, step = c, step * 1.5
    return low[0], low[1], low[3]


def lbfgs(x: np.ndarray, iterations: int, tolerance: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS as a generator: it gives a point and is sent (loss, gradient) there; its value is the last point."""
    loss, slope = yield x
    losses, pairs = [loss], []
    for i in range(iterations):
        if np.linalg.norm(slope) <= max(tolerance * abs(loss), 1e-8):
            break
        way, shares = slope.copy(), []
        for s, y in reversed(pairs):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), share in zip(pairs, reversed(shares)):
            way += s * (share - (y @ way) / (s @ y))
        way = -way
        step, after, steeper = yield from _wolfe(x, loss, slope, way, 1.0 if pairs else 1 / np.linalg.norm(way))
        if not step:
            if not pairs:
                break
            pairs = []  # once more from the plain gradient
            continue
        moved, turned = step * way, steeper - slope
        if moved @ turned > 0:
            pairs = [*pairs, (moved, turned)][-memory:]
        x, loss, slope = x + moved, after, steeper
        losses.append(loss)
        if abs(loss - max(losses[-21:-1])) <= tolerance * abs(losses[0]):
            break
    return x


def fit_mlp_together(train: DataFrame, jobs: Sequence[FitJob], width: int, hidden: Sequence[int] = (128, 128, 128),
                     **params) -> list[Model]:
    """A network for each job, all from the same passes of the rows."""
    settings = dict(
        labelCol="_label", featuresCol="features", layers=[width, *hidden, 2], maxIter=30,
        blockSize=1024, seed=SAMPLE_SEED,
    )
    trainers = [MultilayerPerceptronClassifier(**{**settings, **params}) for _ in jobs]
    get = lambda name: trainers[0].getOrDefault(name)
    if get("solver") != "l-bfgs" or trainers[0].isDefined("initialWeights") or get("layers")[-1] != 2:
        return [t.fit(_labelled(train if kept is None else train.filter(kept), label))
                for t, (label, kept) in zip(trainers, jobs, strict=True)]
    context, layers = train.sparkSession.sparkContext, list(get("layers"))
    x, wrong = vector_to_array(get("featuresCol")), F.raise_error(f"labels must be 0 or 1, features {layers[0]} numbers")
    labels = []
    for label, kept in jobs:
        known = F.col(label).cast("double").isin(0.0, 1.0) & (F.size("_x") == layers[0])
        number = F.when(known, F.col(label).cast("double")).otherwise(wrong.cast("double"))
        labels.append(F.when(F.coalesce(F.lit(True) if kept is None else kept, F.lit(False)), number).otherwise(-1.0))
    rows = stored(train.withColumn("_x", x).select(F.col("_x").alias("x"), F.array(*labels).alias("label"))
                  .repartition(2 * context.defaultParallelism))
    sizes = context._gateway.new_array(context._jvm.int, len(layers))
    for i, n in enumerate(layers):
        sizes[i] = n
    topology = context._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True)
    start = np.array(topology.model(get("seed")).weights().toArray())
    count, iterations, tolerance = len(jobs), get("maxIter"), get("tol")
    searches = {m: lbfgs(start, iterations, tolerance) for m in range(count)}
    points, weights = {m: next(search) for m, search in searches.items()}, [start] * count
    while points:
        sent = context.broadcast(points)
        sums = summed(rows, lambda batch: _network_sums(batch, layers, sent.value, count), count * (len(start) + 2))
        sent.unpersist()
        for m, found in enumerate(sums.reshape(count, -1)):
            if m not in points:
                continue
            try:
                if not found[1]:
                    del points[m]
                    continue
                points[m] = searches[m].send((found[0] / found[1], found[2:] / found[1]))
            except StopIteration as done:
                weights[m] = done.value
                del points[m]
    discard(rows)
    java = context._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel
    return [t._copyValues(MultilayerPerceptronClassificationModel(java(t.uid, _py2java(context, Vectors.dense(w)))))
            for t, w in zip(trainers, weights, strict=True)]


def fit_mlp(train: DataFrame, label: str, width: int, hidden: Sequence[int] = (128, 128, 128), **params) -> Model:
    """Feed-forward network on a dense vector of ``width`` entries.

    Layers, start, loss and the solver's steps are those of ``MultilayerPerceptronClassifier``; rows are
    multiplied as matrices in Python workers, and models that are fitted together share the passes.
    """
    return fit_mlp_together(train, [(label, None)], width, hidden, **params)[0]


def network(width: int, hidden: Sequence[int] = (128, 128, 128), **params) -> Fit:
    """``fit_mlp`` of these settings, for jobs that fit several labels together."""
    fit = lambda df, label: fit_mlp(df, label, width, hidden, **params)
    fit.together = lambda df, jobs: fit_mlp_together(df, jobs, width, hidden, **params)
    return fit


def predict(model: Model, df: DataFrame, out: str) -> DataFrame:
    """Add the probability of the positive class."""
    scored = model.transform(df).withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.drop("rawPrediction", "probability", "prediction")


def multi_action_score(train: DataFrame, score: DataFrame, actions: Sequence[str], fit: Fit,
                       prefix: str = "") -> DataFrame:
    """One prediction column per action over one shared feature frame."""
    for action, model in zip(actions, fitted(train, [(a, None) for a in actions], fit)):
        score = predict(model, score, f"{prefix}{action}")
    return score


def shared_leaves(train: DataFrame, score: DataFrame, actions: Sequence[str], trees: int = 20,
                  **params) -> tuple[DataFrame, DataFrame]:
    """Training and scoring rows, stored, with one representation for all actions.

    One forest learns which actions go together, as the classes of their combinations; a row is
    then the set of leaves it falls into, one slot per tree and leaf. Rows of combinations that
    the forest has not learned from get leaves all the same.
    """
    settings = dict(labelCol="_label", featuresCol="features", numTrees=trees, maxDepth=5, seed=SAMPLE_SEED)
    combination = sum((F.coalesce(F.col(a), F.lit(0)).cast("int") * 2 ** i for i, a in enumerate(actions)), F.lit(0))
    forest = RandomForestClassifier(**{**settings, **params}).fit(train.withColumn("_label", combination.cast("double")))
    sizes = [tree.numLeave() for tree in forest._java_obj.trees()]
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    starts = f"array({', '.join(map(str, firsts))})"

    def represented(df: DataFrame) -> DataFrame:
        leaves = forest.transform(df, {forest.leafCol: "_leaves"}).drop("rawPrediction", "probability", "prediction")
        at = F.expr(f"transform(_in_tree, (leaf, tree) -> cast(leaf AS int) + get({starts}, tree))")
        ones = F.array_repeat(F.lit(1.0), len(sizes))
        named = leaves.withColumn("_in_tree", vector_to_array("_leaves")).withColumn(
            "features", sparse_struct(sum(sizes), at, ones)).drop("_leaves", "_in_tree")
        return stored_vectors(named, "features")

    return represented(train), represented(score)


def fit_linear(train: DataFrame, label: str, **params) -> Model:
    """Logistic regression, for sparse representations that others have learned."""
    settings = dict(labelCol="_label", featuresCol="features", regParam=1e-3, maxIter=50)
    return LogisticRegression(**{**settings, **params}).fit(_labelled(train, label))


def joint_action_score(train: DataFrame, score: DataFrame, actions: Sequence[str], trees: int = 20,
                       **params) -> DataFrame:
    """One prediction column per action, all from one shared representation."""
    seen, asked = shared_leaves(train, score, actions, trees, **params)
    return multi_action_score(seen, asked, actions, fit_linear)


def ensemble_mean(results: Sequence[DataFrame], keys: Sequence[str], actions: Sequence[str]) -> DataFrame:
    """Mean prediction per key over several results."""
    return blend(results, keys, actions)


def blend(results: Sequence[DataFrame], keys: Sequence[str], actions: Sequence[str],
          weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean of predictions per key; equal weights by default.

    Results are stacked and aggregated, so it is one exchange for any number of results.
    """
    weights = list(weights) if weights is not None else [1.0] * len(results)
    stacked = reduce(DataFrame.unionByName, [
        r.select(*keys, *actions, F.lit(float(w)).alias("_w")) for r, w in zip(results, weights, strict=True)
    ])
    mean = lambda a: F.sum(F.col(a) * F.col("_w")) / F.sum(F.when(F.col(a).isNotNull(), F.col("_w")))
    return stacked.groupBy(*keys).agg(*[mean(a).alias(a) for a in actions])


def kfold_ensemble(train: DataFrame, score: DataFrame, actions: Sequence[str], k: int, fit: Fit,
                   keys: Sequence[str] = ("userid", "feedid"), fold: str = "fold") -> DataFrame:
    """Fit on the complement of every fold, predict the whole scoring set, average."""
    found = iter(fitted(train, [(a, F.col(fold) != i) for i in range(k) for a in actions], fit))
    results = []
    for _ in range(k):
        scored = score
        for action in actions:
            scored = predict(next(found), scored, action)
        results.append(scored.select(*keys, *actions))
    return ensemble_mean(results, keys, actions)


def feature_importance(model: Model, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(feature, importance) of the strongest features; one number per model input."""
    values = model.featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values, strict=True)]
    ranked = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return ranked.orderBy(F.desc("importance"), "feature").limit(top)

