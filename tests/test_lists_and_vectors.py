import numpy as np
import pytest
from pyspark.sql import functions as F

from actionloom.functions.lists import merge_keywords, merge_tags
from actionloom.functions.vectors import parse_vector, vector_summary
from actionloom.operators import reduce, tokens
from actionloom.spec import FeatureSpec


def test_keyword_sides(spark):
    rows = [("1;3", None), (None, "2"), (None, None), ("1;3", "3;4"), ("", "5"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(merge_keywords(F.col("a"), F.col("b"))).collect()]
    assert got == [[0, 2, 4], [0, 3], [0], [2, 4, 5], [6], [0]]


def test_tag_threshold_is_strict(spark):
    rows = [("4", "12 0.7;5 0.6;9 0.61"), (None, "1 0.2"), ("4", None), ("", "1 0.2"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(merge_tags(F.col("a"), F.col("b"))).collect()]
    assert got == [[5, 10, 13], [0], [0, 5], [], [0]]


def test_user_lists_cover_users_without_actions(spark):
    spec = FeatureSpec(actions=("like",))
    log = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0), (3, 9, 1)],
                                "userid long, feedid long, like int")
    lists = spark.createDataFrame([(1, [2], [5, 6]), (2, [3], [7]), (3, [2, 4], [6])],
                                  "feedid long, feed_keyword_list array<int>, feed_tag_list array<int>")
    got = {r["userid"]: (r["user_tag_list"], r["user_keyword_list"])
           for r in tokens.user_token_lists(log, lists, spec).collect()}
    assert got == {1: ([5, 6], [2, 4]), 2: ([], []), 3: ([], [])}


def test_multihot(spark):
    df = spark.createDataFrame([(1, [3, 9]), (2, []), (3, [1, 3, 9, 12])], "userid long, tags array<int>")
    got = {r["userid"]: r["e"] for r in tokens.multihot(df, "userid", "tags", "e").collect()}
    assert got == {1: "0 1 1 0", 2: "0 0 0 0", 3: "1 1 1 1"}


def test_vector_summary(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert tuple(df.select(*vector_summary(F.col("v"), "v")).first()) == (2.0, 3.0, 6.0)
    assert df.select(*vector_summary(F.col("v"), "v", compat=True)).first()["v_sum"] == 11.0


def test_blank_vectors_are_zeros(spark):
    df = spark.createDataFrame([(" 1.5 -2 ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_vector(F.col("t"), 2)).collect()] == [[1.5, -2.0], [0, 0], [0, 0]]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 5.0
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def test_pca_against_eigenvectors(cloud):
    x, df = cloud
    reduced, explained = reduce.pca_k(df, "v", 3)
    got = np.array([r["reduced"] for r in reduced.orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    order = np.argsort(values)[::-1][:3]
    assert np.allclose(np.abs(got), np.abs(centred @ vectors[:, order]), atol=1e-8)
    assert np.allclose(explained, values[order] / values.sum())
    assert np.allclose(got.mean(axis=0), 0)


def test_pca_to_a_variance_ratio(cloud):
    x, df = cloud
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    need = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9) + 1)
    reduced, explained = reduce.pca_ratio(df, "v", 0.9)
    assert len(explained) == need and reduced.first()["reduced"].__len__() == need


def test_word_vectors(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [2, 3]), (3, [])], "id long, t array<int>")
    rows = {r["id"]: r["embedding"] for r in reduce.token_word2vec(df, "t", 8, partitions=1).collect()}
    assert all(len(v) == 8 for v in rows.values()) and not any(rows[3]) and any(rows[1])
