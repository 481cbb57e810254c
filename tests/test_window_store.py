"""Rolling statistics as of a day, and window statistics kept up to date day by day."""

import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from actionloom.functions.signals import watch_signals
from actionloom.operators import assemble, windows
from actionloom.plans.window_store import WindowStore
from actionloom.spec import ACTIONS_ALL, ROLLING_KEY_SETS, FeatureSpec

SPEC = FeatureSpec(last_day=12, n_day=3)


def log(spark, seed=1, n=400, days=range(1, 13)):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([10, 11, 12, None]), r.choice([100, 101, None]), r.choice(list(days)),
             float(r.randrange(9000)), r.choice([None, 2.0, 5.0]), r.randrange(2)) for _ in range(n)]
    df = spark.createDataFrame(
        rows, "userid long, feedid long, authorid long, date_ int, play double, videoplayseconds double, like int")
    others = {a: F.lit(1) for a in ACTIONS_ALL if a != "like"}
    return watch_signals(df.withColumns({**others, "stay": F.col("play") + 1}))


def rows_of(df):
    # Sums of doubles depend on their order in the last digits.
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("keys", ROLLING_KEY_SETS)
def test_as_of_agrees_with_all_target_days(spark, keys):
    history = log(spark).cache()
    probes = log(spark, 2, 60, days=range(0, 15))
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    found = windows.rolling_stats_as_of(history, probes, keys, SPEC)
    asked = probes.filter(known).select(*keys, "date_").distinct()
    assert rows_of(found) == rows_of(windows.rolling_stats(history, keys, SPEC).join(asked, [*keys, "date_"], "left_semi"))


def test_probes_without_history(spark):
    nothing = log(spark).limit(0)
    assert windows.rolling_stats_as_of(nothing, log(spark), ["userid"], SPEC).count() == 0
    assert windows.rolling_stats_as_of(log(spark), nothing, ["userid"], SPEC).count() == 0


def test_attach_rolling_fans_nothing_out(spark):
    history = log(spark)
    plan = assemble.attach_rolling(history.select("userid", "feedid", "authorid", "date_"), history, ROLLING_KEY_SETS, SPEC)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and text.count("Window ") == len(ROLLING_KEY_SETS)
    # Per key set: one aggregation and one window over it; the rows themselves meet one join.
    assert text.count("Aggregate") == len(ROLLING_KEY_SETS)


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _day(name):
    return int(name.split("date_=")[1].split("/")[0])


def test_days_one_by_one(spark, tmp_path):
    whole = log(spark).cache()
    items = spark.createDataFrame([(10, 4.0), (11, 0.0), (12, None)], "feedid long, videoplayseconds double")
    store = WindowStore(spark, str(tmp_path), SPEC, items, [("authorid",)])
    assert store.add(whole.filter("date_ <= 5")) == list(range(2, 9))
    for day in range(6, 13):
        before = _files(tmp_path)
        fed = store.add(whole.filter(F.col("date_") == day))
        assert fed == list(range(day + 1, min(day + 3, 12) + 1))
        after = _files(tmp_path)
        changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
        assert {_day(f) for f in changed if "_stats/" in f} == set(fed)
        assert {_day(f) for f in changed if "_stats/" not in f} == {day}
    assert rows_of(store.user_stats()) == rows_of(windows.user_window_stats(whole, SPEC))
    assert rows_of(store.item_stats()) == rows_of(windows.item_window_stats(whole, items, SPEC))
    assert rows_of(store.rolling_stats(("authorid",))) == rows_of(windows.rolling_stats(whole, ("authorid",), SPEC))


def test_a_day_again_and_corrected(spark, tmp_path):
    """Adding a day again changes nothing; a corrected day counts as corrected, also where it leaves no row."""
    whole = log(spark, days=range(1, 7)).cache()
    store = WindowStore(spark, str(tmp_path), SPEC)
    store.add(whole)
    store.add(whole.filter("date_ = 3"))
    assert rows_of(store.user_stats()) == rows_of(windows.user_window_stats(whole, SPEC))
    lonely = WindowStore(spark, str(tmp_path / "b"), SPEC)
    lonely.add(whole.filter("date_ = 1 AND userid = 1"))
    corrected = whole.filter("date_ = 1").limit(1).withColumn("userid", F.lit(None).cast("long"))
    lonely.add(corrected)
    assert lonely.user_stats().count() == 0
    assert rows_of(lonely.item_stats()) == rows_of(windows._entity_window_stats(corrected, "item", SPEC))


def test_nothing_to_add(spark, tmp_path):
    assert WindowStore(spark, str(tmp_path), SPEC).add(log(spark).limit(0)) == []
    assert WindowStore(spark, str(tmp_path), replace(SPEC, last_day=3)).add(log(spark).filter("date_ = 9")) == []
