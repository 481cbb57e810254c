import math

import pytest
from pyspark.sql import functions as F

from actionloom.operators import models
from actionloom.operators.evaluate import uauc
from actionloom.operators.sampling import assign_folds
from actionloom.plans import training
from actionloom.queries import catalog
from actionloom.sources.bindings import EVENTS_SPEC, Tables
from actionloom.spec import FeatureSpec

SPEC = FeatureSpec(last_day=15)
SMALL = dict(maxDepth=3)


@pytest.fixture(scope="module")
def planted(spark):
    """1,200 rows whose label follows one feature, with some noise, on days 1..14."""
    mix = lambda salt: F.pmod(F.xxhash64("event_id", F.lit(salt)), F.lit(1000)) / 1000
    df = spark.range(1200).withColumnRenamed("id", "event_id").select(
        "event_id", (F.col("event_id") % 12).alias("userid"), (F.col("event_id") % 50).alias("feedid"),
        (F.col("event_id") % 14 + 1).cast("int").alias("date_"), mix(1).alias("x"), mix(2).alias("z"),
        ((mix(1) + 0.3 * mix(3)) > 0.8).cast("int").alias("like"),
    )
    df = df.withColumn("forward", 1 - F.col("like"))
    return models.dense_features(df, ["x", "z"]).repartition(2).cache()


def quality(scored, action="like"):
    renamed = scored.withColumnRenamed("p", f"p_{action}")
    return uauc(renamed, [action], decimals=None).first()["uauc"]


def test_early_stop_and_refit_find_the_signal(planted):
    stopped, final = models.fit_gbt_refit(planted, "like", SPEC, 8, **SMALL)
    assert final.getNumTrees == stopped.getNumTrees <= 8
    assert quality(models.predict(final, planted, "p")) > 0.8


def test_weighted_trees_and_importance(planted):
    model = models.fit_gbt_weighted(planted, "like", 5, **SMALL)
    assert quality(models.predict(model, planted, "p")) > 0.8
    top = models.feature_importance(model, ["x", "z"], 1).collect()
    assert [r["feature"] for r in top] == ["x"]


def test_same_seed_same_predictions(planted):
    run = lambda: [r["p"] for r in models.predict(
        models.fit_gbt(planted, "like", 3, **SMALL), planted, "p").orderBy("event_id").select("p").collect()]
    assert run() == run()


def test_fits_get_even_parts_for_all_cores(planted, monkeypatch):
    monkeypatch.setattr(models, "FEW_ROWS", 1000)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    cores = planted.sparkSession.sparkContext.defaultParallelism
    uneven = planted.repartition(3, F.col("userid") > 10).select("userid", "like", "features")
    with models.dealt(uneven) as rows:
        parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) % cores == 0 and max(parts) <= 110 and sum(parts) == 1200
        assert rows.exceptAll(uneven).isEmpty() and uneven.exceptAll(rows).isEmpty()
        model = models.fit_gbt_weighted(rows, "like", 5, **SMALL)
    assert not rows.is_cached
    assert quality(models.predict(model, planted, "p")) > 0.8
    with models.dealt(uneven.limit(1000)) as rows:
        assert not rows.is_cached


def test_network_finds_the_signal(planted):
    model = models.fit_mlp(planted, "like", 2, (8,), maxIter=40)
    assert quality(models.predict(model, planted, "p")) > 0.8


def test_rolling_table_attaches_the_few_columns_first(spark):
    """Each join moves the rows with all they have by then; the statistics themselves are read from the stored rows."""
    t = Tables(spark, "/root/testdata/sf0.001")
    table = training.rolling_feature_table(t.interactions().filter("date_ < 30"), t.scoring(), t.items(), EVENTS_SPEC)
    joins = [line for line in table._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert "date_" in joins[0] and len(joins) == 10  # eight of the rows, two within the pair counts
    assert table.columns[-1] == "authorid_in_userid_count_prop"


def test_small_fits_run_side_by_side_and_give_the_same(planted):
    import threading
    together = threading.Barrier(2, timeout=60)
    fit = lambda df, label: together.wait() is not None and models.fit_gbt(df, label, 3, **SMALL)
    found = models.fitted(planted, [("like", None), ("forward", None)], fit)
    for label, model in zip(("like", "forward"), found, strict=True):
        assert model.toDebugString.split("\n")[1:] == models.fit_gbt(planted, label, 3, **SMALL).toDebugString.split("\n")[1:]


def test_network_takes_the_library_s_steps(planted):
    """Weights equal those of the library's trainer; networks fitted together are those fitted alone."""
    rows = planted.limit(1000).coalesce(1).cache()
    for iterations, close in ((3, 1e-7), (12, 1e-3)):
        mine = models.fit_mlp(rows, "like", 2, (6, 5), maxIter=iterations)
        theirs = models.MultilayerPerceptronClassifier(
            labelCol="like", layers=[2, 6, 5, 2], maxIter=iterations, blockSize=1024, seed=models.SAMPLE_SEED).fit(rows)
        assert mine.weights.toArray() == pytest.approx(theirs.weights.toArray(), abs=close)
    jobs = [("like", None), ("forward", F.col("event_id") % 3 != 0)]
    for (label, kept), model in zip(jobs, models.network(2, (6,), maxIter=4).together(rows, jobs), strict=True):
        alone = models.fit_mlp(rows if kept is None else rows.filter(kept), label, 2, (6,), maxIter=4)
        assert model.weights.toArray() == pytest.approx(alone.weights.toArray(), abs=1e-8)
    rows.unpersist()


def test_training_queries_take_the_whole_job(spark, monkeypatch):
    """The registered queries pass no settings that shorten the operators' own."""
    seen = {}

    class Stop(Exception):
        pass

    def note(name):
        def noted(*args, **params):
            seen[name] = args, params
            raise Stop
        return noted

    monkeypatch.setattr(catalog.training, "train_rolling_gbt", note("gbt_early_stop_refit"))
    monkeypatch.setattr(catalog.training, "train_staged_gbt", note("gbt_weighted"))
    monkeypatch.setattr(catalog.training, "rolling_feature_table", lambda *args: None)
    monkeypatch.setattr(catalog, "_mixed", lambda t: (None, None))
    monkeypatch.setattr(catalog, "_dense_table", lambda t: (None, None, ["x"] * 7))
    monkeypatch.setattr(catalog.models, "network", note("fm_mlp_blend"))
    for name in ("gbt_early_stop_refit", "gbt_weighted", "fm_mlp_blend"):
        with pytest.raises(Stop):
            catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen["gbt_early_stop_refit"][1] == {"extra_excluded": ["event_id"]}
    assert seen["gbt_weighted"][0][4:] == ("online",) and not seen["gbt_weighted"][1]
    assert seen["fm_mlp_blend"] == ((7,), {})


def test_factorisation_machine_on_hashed_ids(planted):
    mixed = models.mixed_features(planted.drop("features"), ["userid", "feedid"], ["x", "z"], buckets=256)
    model = models.fit_fm(mixed, "like", maxIter=60, stepSize=0.1)
    assert quality(models.predict(model, mixed, "p")) > 0.7


@pytest.mark.parametrize("kind", ["sparse", "dense"])
def test_factorisation_machine_takes_the_library_s_steps(planted, kind):
    """Coefficients equal those of the library's trainer, whose time grows with rows times ids."""
    rows = planted if kind == "dense" else models.mixed_features(
        planted.drop("features"), ["userid", "feedid"], ["x", "z"], buckets=256)
    settings = dict(factorSize=3, maxIter=9, stepSize=0.1, regParam=0.01, seed=5)
    mine = models.fit_fm(rows, "like", **settings)
    theirs = models.FMClassifier(solver="adamW", labelCol="like", **settings).fit(rows)
    assert mine.linear.toArray() == pytest.approx(theirs.linear.toArray(), abs=1e-12)
    assert mine.factors.toArray().ravel() == pytest.approx(theirs.factors.toArray().ravel(), abs=1e-12)
    assert mine.intercept == pytest.approx(theirs.intercept, abs=1e-12)
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        models.fit_fm(rows.withColumn("like", F.lit(2)), "like", **settings)


def test_factorisation_machines_fitted_together_are_those_fitted_alone(planted):
    """One set of passes serves all actions and folds; rows that a job leaves out do not count for it."""
    rows = assign_folds(models.mixed_features(
        planted.drop("features"), ["userid", "feedid"], ["x", "z"], buckets=256), 3, "event_id")
    settings = dict(factorSize=3, maxIter=5, stepSize=0.1, seed=5)
    jobs = [("like", None), ("forward", F.col("fold") != 1), ("like", F.col("fold") != 2)]
    for (label, kept), model in zip(jobs, models.fit_fm_together(rows, jobs, **settings), strict=True):
        alone = models.fit_fm(rows if kept is None else rows.filter(kept), label, **settings)
        assert model.linear.toArray() == pytest.approx(alone.linear.toArray(), abs=1e-10)
        assert model.factors.toArray().ravel() == pytest.approx(alone.factors.toArray().ravel(), abs=1e-10)
        assert model.intercept == pytest.approx(alone.intercept, abs=1e-10)
    asked = []

    def fit(df, label):
        raise AssertionError("actions are fitted together")

    fit.together = lambda df, jobs: asked.append(len(jobs)) or models.fit_fm_together(df, jobs, **settings)
    score = rows.select("userid", "feedid", "features").limit(5)
    assert models.kfold_ensemble(rows, score, ["like", "forward"], 3, fit).columns == ["userid", "feedid", "like", "forward"]
    assert asked == [6]


def test_factorisation_machine_costs_a_row_its_entries(spark):
    """A million features of which each row has two: no vector as long as the model per row."""
    import pyarrow as pa
    import numpy as np
    width, rows = 1_000_000, 4096
    at = pa.array([[i, width - 1 - i] for i in range(rows)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays(
        [at, pa.array([[1.0, 2.0]] * rows), pa.array(np.arange(rows) % 2.0)], names=["at", "value", "label"])
    places, sums = models._fm_sums(batch, 0.0, np.zeros(width), np.ones((width, 2)))
    assert len(places) == len(sums) == 2 * rows * 3 + 3 == len(set(places.tolist()))
    raw = 2 * (3.0 ** 2 - 5.0) / 2
    pull = 1 / (1 + math.exp(-raw))
    found = dict(zip(places.tolist(), sums.tolist()))
    assert found[0] == pytest.approx(pull * (1 * 3 - 1)) and found[width * 2 + width - 1] == pytest.approx(2 * pull)
    assert found[width * 3 + 2] == rows


def test_fold_ensemble_scores_everything_once(planted):
    train = assign_folds(planted, 3, "event_id")
    score = planted.select("userid", "feedid", "features").dropDuplicates(["userid", "feedid"])
    fit = lambda df, label: models.fit_gbt(df, label, 2, **SMALL)
    out = models.kfold_ensemble(train, score, ["like", "forward"], 3, fit)
    assert out.count() == score.count() and set(out.columns) == {"userid", "feedid", "like", "forward"}
    assert out.filter("abs(`like` + forward - 1) > 0.3").count() == 0


def test_blend_weights(spark):
    a = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.4)], "userid long, feedid long, like double")
    b = spark.createDataFrame([(1, 1, 0.8), (1, 3, 0.6)], "userid long, feedid long, like double")
    got = {r["feedid"]: r["like"] for r in models.blend([a, b], ["userid", "feedid"], ["like"], [3, 1]).collect()}
    assert got == pytest.approx({1: 0.35, 2: 0.4, 3: 0.6})


def test_staged_job(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    run = lambda stage: training.train_staged_gbt(
        t.train(), t.scoring(), t.items(), EVENTS_SPEC, stage, 2, ["like"], maxDepth=2)
    offline = run("offline")
    assert [r["action"] for r in offline.per_action.collect()] == ["like"]
    assert 0 <= offline.weighted.first()["score"] <= 1
    assert run("online").submission.count() == t.scoring().count()
    with pytest.raises(ValueError):
        run("both")


def test_rolling_job(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    table = training.rolling_feature_table(t.train(), t.scoring(), t.items(), EVENTS_SPEC)
    done = training.train_rolling_gbt(table, EVENTS_SPEC, 2, ["like"], ["event_id"], maxDepth=2)
    rows = done.submission.collect()
    assert len(rows) == t.scoring().count() and all(0 <= r["like"] <= 1 for r in rows)
    assert done.per_action.first()["users"] > 0


def test_prefix_margins_against_shorter_models(planted):
    """Every prefix gives the margins and the uauc of the model that has these trees only."""
    model = models.fit_gbt(planted, "like", 7, **SMALL)
    lengths = [1, 2, 4, 7]
    margins = {r["event_id"]: r["margins"] for r in models.prefix_margins(model, planted, lengths).collect()}
    quality_of = {r["trees"]: r for r in models.prefix_uauc(model, planted, "like", lengths=lengths).collect()}
    assert sorted(quality_of) == lengths
    for i, n in enumerate(lengths):
        shorter = models.first_trees(model, n)
        assert shorter.getNumTrees == n
        scored = models.predict(shorter, planted, "p").select("event_id", "userid", "like", "p").collect()
        for r in scored:
            assert r["p"] == pytest.approx(1 / (1 + math.exp(-2 * margins[r["event_id"]][i])), abs=1e-12)
        aucs = []
        for user in {r["userid"] for r in scored}:
            pos = [margins[r["event_id"]][i] for r in scored if r["userid"] == user and r["like"] == 1]
            neg = [margins[r["event_id"]][i] for r in scored if r["userid"] == user and r["like"] == 0]
            if pos and neg:
                aucs.append(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
        assert quality_of[n]["users"] == len(aucs)
        assert quality_of[n]["uauc"] == pytest.approx(sum(aucs) / len(aucs), abs=1e-12)


def test_patience_binds_on_uauc(planted):
    """With more rounds than useful the search ends before the last, at the best round so far."""
    stopped, rounds = models.fit_gbt_early_stop(planted, "like", SPEC, 30, patience=3, **SMALL)
    validation = planted.filter(F.col("date_") == SPEC.validation_day)
    longest = models._gbt(30, **SMALL).fit(models._labelled(planted, "like").filter(F.col("date_") != SPEC.validation_day))
    curve = {r["trees"]: r["uauc"] for r in models.prefix_uauc(longest, validation, "like").collect()}
    assert stopped.getNumTrees == rounds < 30
    assert all(curve[n] <= curve[rounds] for n in range(1, min(30, rounds + 3) + 1))
    coarse, steps = models.fit_gbt_early_stop(planted, "like", SPEC, 30, patience=10, every=5, **SMALL)
    assert coarse.getNumTrees == steps and steps % 5 == 0


def test_early_stop_without_both_classes(planted):
    one_class = planted.withColumn("like", F.when(F.col("date_") == SPEC.validation_day, 0).otherwise(F.col("like")))
    _, rounds = models.fit_gbt_early_stop(one_class, "like", SPEC, 4, **SMALL)
    assert rounds == 1
    _, rounds = models.fit_gbt_early_stop(planted, "like", SPEC, 4, measure="logloss", **SMALL)
    assert 1 <= rounds <= 4
    with pytest.raises(ValueError):
        models.fit_gbt_early_stop(planted, "like", SPEC, 4, measure="guess", **SMALL)


def test_shorter_model_keeps_its_columns(planted):
    model = models.fit_gbt(planted.withColumnRenamed("features", "inputs"), "like", 3, featuresCol="inputs", **SMALL)
    shorter = models.first_trees(model, 2)
    assert shorter.getFeaturesCol() == "inputs"
    assert models.predict(shorter, planted.withColumnRenamed("features", "inputs"), "p").count() == planted.count()


@pytest.mark.parametrize("mode", ["full", "exact", "phase", "stratified"])
def test_sampled_rows_of_an_action(planted, mode):
    from actionloom.spec import EARLY_NEGATIVE_RATE, LATE_NEGATIVE_RATE, NEGATIVE_RATE
    kept = training.sampled_rows(mode, "event_id", first_day=3)(planted, "like")
    rows = planted.filter("date_ >= 3")
    n = lambda df, where: df.filter(where).count()
    assert n(kept, "`like` = 1") == n(rows, "`like` = 1") and n(kept, "date_ < 3") == 0
    negatives = n(rows, "`like` = 0")
    if mode == "full":
        assert n(kept, "`like` = 0") == negatives
    if mode == "exact":
        assert n(kept, "`like` = 0") == round(NEGATIVE_RATE["like"] * negatives)
    if mode == "phase":
        for where, rate in (("date_ < 7", EARLY_NEGATIVE_RATE["like"]), ("date_ >= 7", LATE_NEGATIVE_RATE["like"])):
            assert n(kept, f"`like` = 0 AND {where}") == round(rate * n(rows, f"`like` = 0 AND {where}"))
    if mode == "stratified":
        assert 0.3 * negatives < n(kept, "`like` = 0") < 0.7 * negatives
    with pytest.raises(ValueError):
        training.sampled_rows("guess", "event_id")(planted, "like")


def test_samples_by_several_columns(planted):
    """Rows that agree in all id columns are kept or dropped together."""
    from actionloom.operators.sampling import negative_sample
    twice = planted.unionAll(planted)
    kept = negative_sample(twice, "like", 0.5, ["userid", "feedid", "date_", "event_id"])
    per_row = kept.filter("`like` = 0").groupBy("event_id").count()
    assert {r["count"] for r in per_row.collect()} == {2}
    negatives = twice.filter("`like` = 0").count()
    assert abs(kept.filter("`like` = 0").count() - negatives / 2) <= 1


def test_vectors_in_the_tree_job(spark):
    """Item and user vectors reach the trees; a missing vector counts as zeros."""
    t = Tables(spark, "/root/testdata/sf0.001")
    items = t.items().select("feedid", F.array(F.lit(0.5), F.col("feedid").cast("double")).alias("item_vector"))
    users = t.train().select("userid").distinct().filter("userid % 2 = 0").select(
        "userid", F.array(F.lit(1.0)).alias("user_vector"))
    table = training.rolling_feature_table(t.train(), t.scoring(), t.items(), EVENTS_SPEC, items, users, global_profile=False)
    done = training.train_rolling_gbt(table, EVENTS_SPEC, 3, ["like"], ["event_id"], patience=2, maxDepth=2)
    rows = done.submission.collect()
    assert len(rows) == t.scoring().count() and all(0 <= r["like"] <= 1 for r in rows)
    widths = models.filled_vectors(table, ["item_vector", "user_vector"]).select("item_vector", "user_vector").collect()
    assert {(len(r[0]), len(r[1])) for r in widths} == {(2, 1)}


def test_offline_stage_of_the_side_table_job(spark, planted, tmp_path):
    rows = planted.withColumns({a: F.col("like") for a in ("read_comment", "click_avatar")})
    sample = training.sampled_rows("exact", "event_id")
    done = training.train_side_table(rows, rows.limit(0), SPEC, lambda d, a: models.fit_gbt(d, a, 2, **SMALL),
                                     sample=sample, stage="offline")
    assert done.weighted.first()["score"] > 0.6
    held = rows.filter(F.col("date_") == SPEC.validation_day)
    assert done.submission.count() == held.count()
    verdict = training.offline_verdict(done, rows, str(tmp_path / "offline"), SPEC).first()
    assert verdict["ret"] == 0 and verdict["score"] > 0.6


def test_only_days_that_feed_validation_are_read(spark):
    from actionloom.plans.feature_build import build_features
    t = Tables(spark, "/root/testdata/sf0.001")
    built = build_features(t.interactions(), t.items(), t.scoring(), EVENTS_SPEC)
    day = EVENTS_SPEC.validation_day
    want = built.training.filter(F.col("date_") == day)
    key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())
    assert key(built.validation) == key(want)
    plan = built.validation._jdf.queryExecution().optimizedPlan().toString()
    assert f"<= {day})" in plan or f"< {day + 1})" in plan


def test_one_exchange_of_pairs_for_both_directions(spark):
    from actionloom.operators.windows import item_window_stats, user_window_stats
    t = Tables(spark, "/root/testdata/sf0.001")
    log = t.interactions()
    wide = user_window_stats(log, EVENTS_SPEC).select("date_", F.col("user_feed_cnt").alias("n")).union(
        item_window_stats(log, t.items(), EVENTS_SPEC).select("date_", "feed_user_cnt"))
    wide.collect()
    assert "ReusedExchange" in wide._jdf.queryExecution().executedPlan().toString()
