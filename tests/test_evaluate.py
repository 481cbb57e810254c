import numpy as np
import pytest
from pyspark.sql import functions as F

from actionloom.operators import evaluate
from actionloom.spec import ACTIONS_FIRST_STAGE

A = ACTIONS_FIRST_STAGE


def pair_count_auc(labels, scores):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def frame(spark, rows):
    return spark.createDataFrame(rows, "userid long, like int, p_like double")


def auc_of(df, user=1, **kw):
    return evaluate.user_auc(df, ["like"], **kw).filter(F.col("userid") == user).first()["auc"]


def test_ties_share_their_rank(spark):
    df = frame(spark, [(1, 0, 0.2), (1, 1, 0.2), (1, 1, 0.5)])
    assert auc_of(df) == 0.75
    ranks = [r["rank"] for r in evaluate.average_rank(df, ["userid"], "p_like").orderBy("p_like").collect()]
    assert ranks == [1.5, 1.5, 3.0]


@pytest.mark.parametrize("decimals", [6, None])
def test_ranks_of_unevenly_spread_scores(spark, decimals):
    scores = [-3.5, 0.000001, 0.000001, 0.000002, 0.5, 12.25]
    df = frame(spark, [(u, 1, s) for u in (1, 2) for s in scores]).repartition(3)
    got = evaluate.average_rank(df, ["userid"], "p_like", decimals=decimals).orderBy("userid", "p_like")
    assert [r["rank"] for r in got.collect()] == [1.0, 2.5, 2.5, 4.0, 5.0, 6.0] * 2


def test_users_of_one_class_are_left_out(spark):
    rows = [(1, 1, 0.1), (1, 1, 0.2), (2, 0, 0.3), (2, 0, 0.1), (3, 0, 0.9), (3, 1, 0.1)]
    row = evaluate.uauc(frame(spark, rows), ["like"]).first()
    assert (row["users"], row["uauc"]) == (1, 0.0)


@pytest.mark.parametrize("decimals", [6, None])
def test_against_pair_counts(spark, decimals):
    rng = np.random.default_rng(1)
    n = 1500
    # One user owns a third of the rows; scores leave the unit interval and repeat.
    users = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 9, n))
    labels = rng.integers(0, 2, n)
    scores = np.round(rng.normal(0, 2, n), 2) if decimals else np.where(
        rng.random(n) < 0.3, 0.125, rng.normal(0, 2, n))
    df = frame(spark, [(int(u), int(y), float(s)) for u, y, s in zip(users, labels, scores)]).repartition(5)
    got = {r["userid"]: r["auc"] for r in evaluate.user_auc(df, ["like"], decimals=decimals).collect()}
    for u in range(9):
        m = users == u
        assert got[u] == pytest.approx(pair_count_auc(labels[m], scores[m]), abs=1e-12)


def test_order_is_all_that_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(u), int(y), float(np.round(s, 3))) for u, y, s in
            zip(rng.integers(0, 5, 400), rng.integers(0, 2, 400), rng.random(400))]
    df = frame(spark, rows)
    base = evaluate.uauc(df, ["like"]).first()["uauc"]
    stretched = df.withColumn("p_like", F.col("p_like") * 0.5 + 0.25)
    flipped = df.withColumn("p_like", 1 - F.col("p_like"))
    assert evaluate.uauc(stretched, ["like"]).first()["uauc"] == pytest.approx(base, abs=1e-12)
    assert evaluate.uauc(flipped, ["like"]).first()["uauc"] == pytest.approx(1 - base, abs=1e-12)


def test_weights(spark):
    per_action = spark.createDataFrame(
        [("read_comment", 0.6), ("like", 0.7), ("click_avatar", 0.8), ("forward", 0.5)], "action string, uauc double")
    assert evaluate.weighted_uauc(per_action).first()["score"] == 0.66
    assert evaluate.weighted_uauc(
        per_action, {"read_comment": 0.4, "like": 0.3, "click_avatar": 0.2, "forward": 0.1}).first()["score"] == 0.66


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 4, 0)]
    df = spark.createDataFrame(rows, "userid long, feedid long, y int")
    return df.select("userid", "feedid", *[F.col("y").alias(a) for a in A])


@pytest.fixture(scope="module")
def result(spark):
    rows = [(1, 1, 0.2), (1, 2, 0.2), (1, 3, 0.5), (2, 1, 0.9), (2, 4, 0.1)]
    df = spark.createDataFrame(rows, "userid long, feedid long, p double")
    return df.select("userid", "feedid", *[F.col("p").alias(a) for a in A])


def test_correct_submission(result, labels):
    row = evaluate.score_submission(result, labels).first()
    assert (row["ret"], row["err_msg"], row["score"], row["uauc_like"]) == (0, None, 0.875, 0.875)


def test_extra_row(result, labels):
    row = evaluate.score_submission(result.unionByName(result.limit(1)), labels).first()
    assert row["ret"] == 1 and row["score"] is None
    assert row["err_msg"] == "the result has 6 rows, the label set 5"


def test_row_count_comes_before_columns(result, labels):
    row = evaluate.score_submission(result.drop("like").filter("feedid > 1"), labels).first()
    assert row["ret"] == 1


def test_missing_columns(result, labels):
    row = evaluate.score_submission(result.drop("like", "userid"), labels).first()
    assert (row["ret"], row["err_msg"]) == (2, "columns missing in the result: userid, like")


def test_other_keys(result, labels):
    assert evaluate.score_submission(result.withColumn("feedid", F.col("feedid") + 1), labels).first()["ret"] == 3


def test_repeated_keys_do_not_multiply(result, labels):
    doubled = lambda df: df.withColumn("feedid", F.lit(1).cast("long"))
    assert evaluate.score_submission(doubled(result), doubled(labels)).first()["ret"] == 3


def test_values_that_are_no_numbers(result, labels):
    bad = result.withColumn("like", F.when(F.col("feedid") == 4, "x").otherwise("0.5"))
    assert evaluate.score_submission(bad, labels).first()["ret"] == 4
    nan = result.withColumn("like", F.lit(float("nan")))
    assert evaluate.score_submission(nan, labels).first()["ret"] == 4


def test_no_user_with_both_classes(result, labels):
    row = evaluate.score_submission(result, labels.withColumn("like", F.lit(1))).first()
    assert row["ret"] == 4 and row["score"] is None
    assert evaluate.score_submission(result, labels.drop("like")).first()["ret"] == 4


def test_rounding_before_ranking(spark):
    rows = [(1, 0, 0.30000004), (1, 1, 0.30000001)]
    assert auc_of(frame(spark, rows)) == 0.5
    assert auc_of(frame(spark, rows), decimals=None) == 0.0


def test_ids_that_are_no_numbers(result, labels):
    bad = result.withColumn("userid", F.when(F.col("feedid") == result.first()["feedid"], "x").otherwise(F.col("userid").cast("string")))
    assert evaluate.score_submission(bad, labels).first()["ret"] == 3


def test_counts_of_a_submission_are_taken_once(result, labels):
    """What is planned for a score does not count the pairs again."""
    plan = evaluate.score_submission(result, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Join") == 1  # of the figures; of labels and scores


def test_missing_actions_are_noticed_if_named(spark):
    rows = spark.createDataFrame([("like", 10, 0.8), ("forward", 10, 0.6)], "action string, users long, uauc double")
    assert evaluate.weighted_uauc(rows).first()["score"] == 0.75
    assert evaluate.weighted_uauc(rows, actions=["like", "forward"]).first()["score"] == 0.75
    assert evaluate.weighted_uauc(rows, actions=["like", "forward", "read_comment"]).first()["score"] is None
