"""Factorisation by block power iteration, sparse vectors, sketches and slots."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from actionloom.operators import factors, models, tokens, windows
from actionloom.operators.evaluate import uauc
from actionloom.spec import FeatureSpec


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64)) * (0.9 ** np.arange(64)) @ rng.normal(size=(64, 64)) + 3.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    return x, factors.dense_rows(df.repartition(5), "v", "id").cache()


def test_variances_against_eigenvalues(cloud):
    x, rows = cloud
    found = factors.factorise(rows, 64, 8)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(found.variance, values[:8], rtol=0.01)
    assert np.allclose(found.share, values[:8] / values.sum(), rtol=0.01)
    assert np.allclose(found.directions.T @ found.directions, np.eye(8), atol=1e-9)
    placed = np.array([r.reduced for r in factors.project(rows, found).orderBy("id").collect()])
    assert np.allclose(placed, (x - x.mean(axis=0)) @ found.directions, atol=1e-8)


def test_all_directions_are_exact(cloud):
    x, rows = cloud
    found = factors.factorise(rows, 64, 64)
    assert np.allclose(found.variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1], rtol=1e-6, atol=1e-9)
    assert found.share.sum() == pytest.approx(1)
    need = int(np.searchsorted(np.cumsum(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]) / np.trace(np.cov(x.T)), 0.9) + 1)
    again, k = factors.factorise_to(rows, 64, 0.9, first=4)
    assert k == need and again.share[:k].sum() >= 0.9


def test_same_result_however_split(cloud):
    _, rows = cloud
    one, many = factors.factorise(rows.coalesce(1), 64, 3), factors.factorise(rows.repartition(13), 64, 3)
    assert np.allclose(one.directions, many.directions, atol=1e-6)


def test_wide_sparse_rows(spark):
    """20,000 columns: no square matrix of them could be held."""
    rng = random.Random(4)
    lists = [(i, sorted({rng.randrange(20000) for _ in range(20)} | ({1, 2, 3} if i % 2 else {19999}))) for i in range(400)]
    rows = factors.sparse_rows(spark.createDataFrame(lists, "id long, codes array<int>"), "codes", "id").cache()
    found = factors.factorise(rows, 20000, 2)
    strongest = np.argsort(-np.abs(found.directions[:, 0]))[:4]
    assert set(strongest.tolist()) == {1, 2, 3, 19999}


def test_no_rows_and_no_columns(spark):
    rows = factors.sparse_rows(spark.createDataFrame([(1, None), (2, [])], "id long, codes array<int>"), "codes", "id")
    assert factors.factorise(rows, 0, 4).directions.shape == (0, 0)
    found = factors.factorise(rows.limit(0), 5, 2)
    assert found.variance.tolist() == [0, 0]
    assert [r.reduced for r in factors.project(rows, factors.factorise(rows, 5, 2)).collect()] == [[0, 0], [0, 0]]


def test_mutual_information_against_plain_counts(spark):
    rng = random.Random(9)
    lists = [[rng.choice([3, 5, 8, 13, 21, 34]) for _ in range(rng.randrange(9))] for _ in range(60)] + [None, [7]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, t array<int>")
    pairs, vocabulary = factors.positive_pmi(df, "t", window=2)
    token = {r["code"]: r["token"] for r in vocabulary.collect()}
    assert sorted(token.values()) == sorted({t for x in lists for t in x or []}) and sorted(token) == list(range(len(token)))
    met = Counter()
    for x in lists:
        for i, a in enumerate(x or []):
            for b in x[i + 1:i + 3]:
                met[a, b] += 1
                met[b, a] += 1
    total = Counter()
    for (a, _), n in met.items():
        total[a] += n
    want = {(a, b): math.log(n * sum(met.values()) / total[a] / total[b]) for (a, b), n in met.items()}
    got = {(token[r["code_a"]], token[r["code_b"]]): r["ppmi"] for r in pairs.collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_tokens_used_alike_are_near(spark):
    """Two groups of tokens that never meet; a rare token alone has zeros."""
    rng = random.Random(2)
    lists = [(i, rng.sample(range(10) if i % 2 else range(100, 110), 5)) for i in range(200)] + [(500, [999]), (501, [])]
    df = spark.createDataFrame(lists, "id long, t array<int>").cache()
    vector = {r["token"]: np.array(r["embedding"]) for r in factors.token_embeddings(df, "t", 6).collect()}
    assert len(vector) == 21 and not vector[999].any() and all(len(v) == 6 for v in vector.values())
    cos = lambda a, b: float(vector[a] @ vector[b] / np.linalg.norm(vector[a]) / np.linalg.norm(vector[b]))
    assert min(cos(1, b) for b in range(10)) > max(cos(1, b) for b in range(100, 110)) + 0.3
    means = {r["id"]: np.array(r["embedding"]) for r in factors.list_embeddings(df, "id", "t", 6).collect()}
    assert np.allclose(means[1], np.mean([vector[x] for x in lists[1][1]], axis=0)) and not means[501].any()


def test_multihot_as_sparse_vectors(spark):
    df = spark.createDataFrame([(1, [3, 9]), (2, []), (3, [1, 3, 9, 12]), (4, None)], "userid long, tags array<int>")
    rows, width = tokens.multihot_sparse(df, "userid", "tags", "e")
    got = {r["userid"]: r["e"] for r in rows.collect()}
    assert width == 4 and all(v.size == 4 for v in got.values())
    assert {u: v.toArray().tolist() for u, v in got.items()} == {
        1: [0, 1, 1, 0], 2: [0, 0, 0, 0], 3: [1, 1, 1, 1], 4: [0, 0, 0, 0]}


def test_sketches_over_windows(spark):
    spec = FeatureSpec(last_day=12, n_day=4)
    rng = random.Random(6)
    rows = [(u, rng.randrange(3000 * u), d) for u in (1, 2) for d in range(1, 12) for _ in range(1500)] + [(None, 1, 2), (3, None, 2)]
    df = spark.createDataFrame(rows, "userid long, feedid long, date_ int").cache()
    got = {(r["userid"], r["date_"]): r["n"] for r in windows.approx_distinct_of_sketches(
        windows.distinct_sketches(df, ["userid"], "feedid", spec), ["userid"], "n", spec).collect()}
    want = {(u, t): len({f for uu, f, d in rows if uu == u and f is not None and t - 4 <= d <= t - 1}) for u in (1, 2) for t in range(2, 13)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 0.03 * want[k] for k in want)


@pytest.fixture(scope="module")
def logged(spark):
    mix = lambda salt: F.pmod(F.xxhash64("event_id", F.lit(salt)), F.lit(1000)) / 1000
    df = spark.range(1500).withColumnRenamed("id", "event_id").select(
        "event_id", (F.col("event_id") % 12).alias("userid"), (F.col("event_id") * 7 % 50).alias("feedid"),
        mix(1).alias("x"), mix(2).alias("z"), F.array(mix(3), mix(4)).alias("v"))
    liked = (F.col("feedid") % 5 == 0).cast("int")
    return df.withColumns({"like": liked, "forward": liked}).cache()


def test_each_id_has_a_slot_of_its_own(logged):
    slots = models.fit_id_slots(logged, ["userid", "feedid"])
    assert (slots.width, slots.first) == (12 + 1 + 50 + 1, {"userid": 0, "feedid": 13})
    other = logged.limit(3).withColumn("userid", F.lit(77).cast("long")).withColumn("feedid", F.lit(None).cast("long"))
    rows = models.slot_features(logged.unionByName(other), slots, ["x"], {"v": 2}).collect()
    seen = {}
    for r in rows:
        x = r["features"].toArray()
        at = np.flatnonzero(x[:64]).tolist()
        assert len(x) == 64 + 3 and len(at) == 2 and x[at].tolist() == [1, 1]
        assert np.allclose(x[64:], [r["x"], *r["v"]])
        seen.setdefault((r["userid"], r["feedid"]), set()).add(tuple(at))
    assert seen.pop((77, None)) == {(0, 13)}
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
    model = models.fit_fm(models.slot_features(logged, slots, ["x"]), "like", maxIter=60, stepSize=0.1)
    scored = models.predict(model, models.slot_features(logged, slots, ["x"]), "p_like")
    assert uauc(scored, ["like"], decimals=None).first()["uauc"] > 0.9


def test_joint_representation_beats_separate_models(spark):
    """Two actions that follow the same hidden rule; one is seldom seen in training."""
    mix = lambda salt: F.pmod(F.xxhash64("event_id", F.lit(salt)), F.lit(1000)) / 1000
    df = spark.range(4000).withColumnRenamed("id", "event_id").select(
        "event_id", (F.col("event_id") % 10).alias("userid"), *[mix(i).alias(f"x{i}") for i in range(12)])
    rule = (F.col("x0") > 0.5) != (F.col("x1") > 0.5)
    rare = F.when(F.col("event_id") % 40 == 0, rule).otherwise(F.lit(False))
    df = models.dense_features(df, [f"x{i}" for i in range(12)])
    train = df.filter("event_id < 3000").withColumns({"like": rule.cast("int"), "forward": rare.cast("int")}).cache()
    score = df.filter("event_id >= 3000").withColumns({"like": rule.cast("int"), "forward": rule.cast("int")}).cache()
    prefixed = lambda d: d.withColumnsRenamed({"like": "p_like", "forward": "p_forward"}).join(
        score.select("event_id", "like", "forward"), "event_id")
    bare = score.drop("like", "forward")
    quality = lambda d: {r["action"]: r["uauc"] for r in uauc(prefixed(d), ["like", "forward"], decimals=None).collect()}
    joint = quality(models.joint_action_score(train, bare, ["like", "forward"]).select("event_id", "userid", "like", "forward"))
    alone = quality(models.multi_action_score(train, bare, ["like", "forward"], models.fit_linear).select(
        "event_id", "userid", "like", "forward"))
    assert joint["like"] > 0.9 and joint["forward"] > alone["forward"] + 0.1
