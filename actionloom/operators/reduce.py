"""Reducing item and user vectors, and token embeddings."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionloom.spec import SAMPLE_SEED


def _principal(df: DataFrame, column: str, k: int):
    """Centred vectors in ``_centred`` and the fitted model: the transform does not centre."""
    vectors = df.withColumn("_raw", array_to_vector(F.col(column)))
    centring = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False)
    centred = centring.fit(vectors).transform(vectors)
    return centred, PCA(k=k, inputCol="_centred", outputCol="_scores").fit(centred)


def pca_k(df: DataFrame, column: str, k: int, out: str = "reduced") -> tuple[DataFrame, list[float]]:
    """(df with ``out`` as an array of k doubles, explained variance ratios)."""
    centred, model = _principal(df, column, k)
    reduced = model.transform(centred).withColumn(out, vector_to_array("_scores"))
    return reduced.drop("_raw", "_centred", "_scores"), [float(v) for v in model.explainedVariance]


def pca_ratio(df: DataFrame, column: str, ratio: float, out: str = "reduced") -> tuple[DataFrame, list[float]]:
    """As :func:`pca_k` with the smallest k whose explained variance reaches ``ratio``."""
    width = df.select(F.size(column).alias("d")).first()["d"]
    centred, model = _principal(df, column, width)
    explained = [float(v) for v in model.explainedVariance]
    reached, k = 0.0, 0
    while k < width and reached < ratio:
        reached += explained[k]
        k += 1
    reduced = model.transform(centred).withColumn(out, F.slice(vector_to_array("_scores"), 1, k))
    return reduced.drop("_raw", "_centred", "_scores"), explained[:k]


def token_word2vec(df: DataFrame, column: str, size: int, out: str = "embedding",
                   partitions: int | None = None, iterations: int = 1, seed: int = SAMPLE_SEED) -> DataFrame:
    """Add the mean of the tokens' learnt vectors; every token gets one, however rare.

    The lists are trained on in ``partitions`` parts, by default one per core.
    """
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    words = df.withColumn("_words", F.transform(column, lambda x: x.cast("string")))
    model = Word2Vec(
        vectorSize=size, minCount=0, inputCol="_words", outputCol="_mean", seed=seed,
        numPartitions=partitions, maxIter=iterations,
    ).fit(words)
    return model.transform(words).withColumn(out, vector_to_array("_mean")).drop("_words", "_mean")


def wide(df: DataFrame, column: str, prefix: str, k: int) -> DataFrame:
    """One column per vector entry, for sinks that want flat tables."""
    return df.select(
        *[c for c in df.columns if c != column],
        *[F.get(F.col(column), F.lit(i)).alias(f"{prefix}{i}") for i in range(k)],
    )
