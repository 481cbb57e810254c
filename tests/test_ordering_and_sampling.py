import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from actionloom.operators import encode, ordering, sampling
from actionloom.operators.ordering import exact_quantiles, ordered_codes, sliced_rank


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40 + 1).alias("userid"),
        (F.col("id") % 14 + 1).cast("int").alias("date_"),
        (F.col("id") % 7 == 0).cast("int").alias("like"),
    ).repartition(4)


def hashed(ids, seed=2021):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def test_exact_negative_sample(rows):
    got = sampling.negative_sample(rows, "like", 0.3, "event_id").collect()
    negatives = [i for i in range(1000) if i % 7]
    kept = {r["event_id"] for r in got if r["like"] == 0}
    assert kept == set(hashed(negatives)[: round(0.3 * len(negatives))])
    assert sum(r["like"] for r in got) == 1000 - len(negatives)


@pytest.mark.parametrize("frac", [0.0, 1.0])
def test_sample_none_and_all(rows, frac):
    n = sampling.negative_sample(rows, "like", frac, "event_id").filter("like = 0").count()
    assert n == (857 if frac else 0)


def test_phase_sample(rows):
    got = sampling.negative_sample_phase(rows, "like", 0.1, 0.5, "event_id").filter("like = 0").collect()
    for late, frac in ((True, 0.5), (False, 0.1)):
        part = [i for i in range(1000) if i % 7 and ((i % 14 + 1) >= 7) == late]
        kept = {r["event_id"] for r in got if (r["date_"] >= 7) == late}
        assert kept == set(hashed(part)[: round(frac * len(part))])


def test_stratified_sample(rows):
    got = sampling.negative_sample_stratified(rows, "like", 0.5, "event_id").filter("like = 0")
    sizes = {(r["userid"], r["date_"]): r["count"] for r in got.groupBy("userid", "date_").count().collect()}
    full = rows.filter("like = 0").groupBy("userid", "date_").count().collect()
    assert all(sizes.get((r["userid"], r["date_"]), 0) == round(0.5 * r["count"]) for r in full)


def test_sliced_rank_numbers_every_group(rows):
    ranked = sliced_rank(rows, ["userid"], "event_id", 7, digits=1)
    for r in ranked.groupBy("userid").agg(
        F.sort_array(F.collect_list("rank")).alias("ranks"), F.max("group_size").alias("n")
    ).collect():
        assert r["ranks"] == list(range(1, r["n"] + 1))


@pytest.mark.parametrize("k", [1, 3, 7])
def test_folds(rows, k):
    got = sampling.assign_folds(rows, k, "event_id").groupBy("fold").count().collect()
    sizes = [r["count"] for r in sorted(got)]
    assert sizes == [1000 // k + (i < 1000 % k) for i in range(k)]


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 2, 11), (1, 2, 1, 12)], "u int, f int, date_ int, id int")
    got = sorted(r["id"] for r in sampling.keep_last(df, ["u", "f"], ["date_", "id"]).collect())
    assert got == [11, 12]


def test_codes_follow_the_order(spark):
    df = spark.createDataFrame([(10,), (9,), (100,), (9,), (None,)], "x long")
    assert {r["x"]: r["code"] for r in ordered_codes(df, "x").collect()} == {9: 0, 10: 1, 100: 2}
    numeric = {r["x"]: r["c"] for r in encode.label_encode(df, "x", "numeric", "c").collect()}
    assert numeric == {9: 0, 10: 1, 100: 2, None: None}
    text = {r["x"]: r["c"] for r in encode.label_encode(df, "x", "string", "c").collect()}
    assert text == {10: 0, 100: 1, 9: 2, None: 3}


def test_quantiles_of_awkward_columns(spark):
    rng = np.random.default_rng(4)
    cols = {
        "normal": rng.normal(size=3000) * 1e-4, "heavy": np.where(rng.random(3000) < 0.4, 7.0, rng.random(3000)),
        "constant": np.full(3000, 5.0), "huge": 10.0 ** rng.integers(-20, 20, 3000),
    }
    data = [tuple(float(cols[c][i]) for c in cols) for i in range(3000)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in cols)).repartition(6)
    df = df.unionByName(spark.createDataFrame([(None, float("nan"), 5.0, 1.0)], df.schema))
    shares = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.8, "f": 1.0}
    got = exact_quantiles(df, list(cols), shares)
    cols["constant"], cols["huge"] = np.append(cols["constant"], 5.0), np.append(cols["huge"], 1.0)
    for c, v in cols.items():
        for name, p in shares.items():
            assert got[c][name] == pytest.approx(np.quantile(v, p), rel=1e-12)


def test_images_are_ordered_bits(spark):
    """Every double, also the least and the largest, against the bits themselves."""
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2047 << 52, 4000, dtype=np.int64).view(np.float64)
    edges = [0.0, 5e-324, 2.0 ** -1022, np.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, np.inf, 1.0, np.nextafter(1, 0),
             np.nextafter(2, 0), 2.0, 2.0 ** 1023, np.nextafter(2.0 ** 1023, 0), 0.1, 3.0, 1e300]
    powers = 2.0 ** np.arange(-1074, 1024)
    sizes = np.concatenate([bits, edges, powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)])
    values = np.concatenate([sizes, -sizes])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, value double")
    got = {r["i"]: r["image"] for r in ordering.ordered_image(df).collect()}
    for i, v in enumerate(values):
        size = int(np.abs(v).view(np.int64))
        assert got[i] == (-1 - size if v < 0 else size), v
        assert ordering._of_image(got[i]) == v


def test_quantiles_count_at_most_one_digit_a_pass(spark, monkeypatch):
    """One huge value and a share near 1: no pass hands more than the wanted places to the driver."""
    seen = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    df = spark.range(20000).select(F.when(F.col("id") == 7, 1e300).otherwise(F.col("id") / 20000).alias("x"))
    got = exact_quantiles(df, ["x"], {"a": 0.99999, "b": 0.5})
    want = np.append(np.delete(np.arange(20000) / 20000, 7), 1e300)
    assert got["x"]["a"] == pytest.approx(np.quantile(want, 0.99999), rel=1e-12)
    assert got["x"]["b"] == pytest.approx(np.quantile(want, 0.5), rel=1e-12)
    assert max(map(len, seen)) <= 4 and len(seen) == 5


def test_quantiles_are_not_ordered_by_value(spark):
    """A constant column is one stored row, whatever its length."""
    df = spark.range(50000).select(F.lit(2.5).alias("x"))
    assert exact_quantiles(df, ["x"], {"m": 0.5, "top": 1.0}) == {"x": {"m": 2.5, "top": 2.5}}
    infinite = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double")
    assert exact_quantiles(infinite, ["x"], {"a": 0.0, "m": 0.5, "b": 1.0})["x"] == {
        "a": float("-inf"), "m": 1.0, "b": float("inf")}


def test_quantiles_of_sorted_and_empty_input(spark):
    df = spark.range(0, 5000, 1, 20).select(F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    got = exact_quantiles(df, ["x", "y"], {"m": 0.5})
    assert got == {"x": {"m": 2499.5}, "y": {"m": None}}


def test_robust_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, c double")
    got = encode.robust_scale(df, ["x", "c"]).orderBy("x").collect()
    assert [r["x"] for r in got] == pytest.approx([-1.0, -1 / 3, 1 / 3, 1.0])
    assert [r["c"] for r in got] == [0.0] * 4


def test_winsor(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(11)], "x double, c double")
    got = [r["x"] for r in encode.winsor_minmax(df, ["x", "c"]).orderBy("x").collect()]
    assert max(got) == 1.0 and min(got) == 0.0 and sum(v == 1.0 for v in got) == 3


def test_narrow_types_are_strict(spark):
    df = spark.createDataFrame([(126, 127, 32767, None, 2.5), (-127, -128, 0, 4, 1e39)],
                               "a long, b long, c long, gaps long, d double")
    assert dict(encode.narrow_types(df, df.columns).dtypes) == {
        "a": "tinyint", "b": "smallint", "c": "int", "gaps": "float", "d": "double"}
