import pytest
from pyspark.sql import functions as F

from actionloom.operators import windows
from actionloom.operators.windows import covered_targets, explode_target_days
from actionloom.session import input_bytes
from actionloom.sources.bindings import EVENTS_SPEC, Tables
from actionloom.spec import ACTIONS_ALL, FeatureSpec

SPEC = FeatureSpec()


def log(spark, rows):
    """(userid, feedid, date_, like) rows with the other measures filled in."""
    df = spark.createDataFrame(rows, "userid long, feedid long, date_ int, like int")
    zero = {a: F.lit(0) for a in ACTIONS_ALL if a != "like"}
    return df.withColumns({**zero, "play": F.lit(1000.0), "stay": F.lit(2000.0)})


def days(df, user=1):
    return sorted(r["date_"] for r in df.filter(F.col("userid") == user).collect())


def test_edges_of_the_window(spark):
    one = lambda d: log(spark, [(1, 1, d, 0)])
    expected = {1: [2, 3, 4, 5, 6], 5: [6, 7, 8, 9, 10], 6: [7, 8, 9, 10, 11], 14: [15], 15: [], 20: []}
    for d, targets in expected.items():
        assert days(explode_target_days(one(d), SPEC)) == targets
        assert days(windows.user_window_stats(one(d), SPEC)) == targets
        assert days(covered_targets(one(d), ["userid"], "feedid", SPEC)) == targets


def test_no_leakage_from_the_target_day(spark):
    before = [(1, i, d, 0) for d in range(1, 15) for i in (d, d + 1)]
    after = [(u, f + 1000, d, 1) if d == 7 else (u, f, d, like) for u, f, d, like in before]
    stats = lambda rows: {r["date_"]: r for r in windows.user_window_stats(log(spark, rows), SPEC).collect()}
    a, b = stats(before), stats(after)
    assert all(a[d] == b[d] for d in range(2, 8))
    assert a[8] != b[8]
    assert a[13] == b[13]


def test_distinct_items_over_overlapping_days(spark):
    rows = [(1, 7, 1, 0), (1, 7, 3, 0), (1, 8, 3, 0), (1, 7, 9, 0)]
    got = {r["date_"]: (r["user_action_cnt"], r["user_feed_cnt"])
           for r in windows.user_window_stats(log(spark, rows), SPEC).collect()}
    assert got == {2: (1, 1), 3: (1, 1), 4: (3, 2), 5: (3, 2), 6: (3, 2), 7: (2, 2), 8: (2, 2),
                   10: (1, 1), 11: (1, 1), 12: (1, 1), 13: (1, 1), 14: (1, 1)}


def test_distinct_counts_over_a_long_horizon(spark):
    """Several bitmap blocks, against an explicit range join."""
    spec = FeatureSpec(last_day=200, n_day=7)
    rows = [(i % 3, (i * 7) % 11, (i * 37) % 205 + 1, 0) for i in range(900)]
    df = log(spark, rows)
    got = {(r["userid"], r["date_"]): (r["user_action_cnt"], r["user_feed_cnt"])
           for r in windows.user_window_stats(df, spec).collect()}
    expected = {}
    for t in range(2, 201):
        for u in range(3):
            inside = [f for uu, f, d, _ in rows if uu == u and t - 7 <= d <= t - 1]
            if inside:
                expected[u, t] = (len(inside), len(set(inside)))
    assert got == expected


def test_a_value_travels_as_runs_of_target_days(spark):
    """One row for a single visit, whatever the window width; runs end at a block of the bitmap."""
    spec = FeatureSpec(last_day=200, n_day=7)
    visits = {(1, 1): [3], (1, 2): [10, 14, 30], (2, 1): [57, 58], (2, 2): [199, 200], (3, 1): [61, 122, 123, 190]}
    rows = [(u, f, d, 0) for (u, f), ds in visits.items() for d in ds]
    spans = [tuple(r) for r in windows.covered_spans(log(spark, rows), ["userid", "feedid"], "like", spec).select(
        "userid", "feedid", "_from", "_to").collect()]
    covered = sorted((u, f, t) for u, f, low, high in spans for t in range(low, high + 1))
    assert covered == sorted({(u, f, t) for u, f, d, _ in rows for t in range(d + 1, min(d + 7, 200) + 1)})
    found = lambda u, f: sorted(x[2:] for x in spans if x[:2] == (u, f))
    assert found(1, 1) == [(4, 10)] and found(1, 2) == [(11, 21), (31, 37)] and found(2, 2) == [(200, 200)]
    assert found(2, 1) == [(58, 61), (62, 65)]  # the first block ends with day 61


def test_partitions_of_the_fan_out_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Were they as many for any input, the groups in the memory of a task would grow with it."""
    path = str(tmp_path / "log with space")
    log(spark, [(i % 50, i % 7, i % 14 + 1, i % 2) for i in range(3000)]).withColumns({
        "is_finish": F.lit(1), "play_times": F.lit(0.5)}).write.parquet(path)
    kept = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "log with space").glob("*.parquet"))
    assert input_bytes(kept) == input_bytes(kept.join(kept.select("userid").distinct(), "userid")) == size
    assert input_bytes(spark.range(3)) == 0
    asked = [lambda: windows.rolling_stats(kept, ["userid"], SPEC), lambda: windows.user_window_stats(kept, SPEC)]
    plainly = [sorted(f().collect()) for f in asked]
    monkeypatch.setattr(windows, "_FILE_BYTES", size // 40)
    for f, rows in zip(asked, plainly):
        assert f().rdd.getNumPartitions() >= 40
        assert sorted(f().collect()) == rows


def test_missing_measures(spark):
    df = log(spark, [(1, 1, 1, 0)]).withColumn("play", F.lit(None).cast("double")).withColumn(
        "like", F.lit(None).cast("int"))
    row = windows.user_window_stats(df, SPEC).filter("date_ = 2").first()
    assert row["user_play_avg"] is None and row["user_like_sum"] == 0 and row["user_like_avg"] is None


def test_null_keys_have_no_group_and_attach_as_null(spark):
    df = log(spark, [(1, 1, 1, 0), (2, 2, 1, 1)]).withColumns({
        "authorid": F.when(F.col("feedid") == 1, F.lit(9).cast("long")),
        "is_finish": F.lit(1), "play_times": F.lit(0.5),
    })
    stats = windows.rolling_stats(df, ["authorid"], SPEC)
    assert {r["authorid"] for r in stats.collect()} == {9}
    later = df.withColumn("date_", F.lit(2))
    got = {r["userid"]: r["authorid_5day_count"] for r in
           windows.attach(later, stats, ["authorid", "date_"]).collect()}
    assert got == {1: 1, 2: None}


@pytest.mark.parametrize("keys", [["userid"], ["userid", "authorid"]])
def test_range_frame_agrees_with_the_fan_out(spark, keys):
    watched = Tables(spark, "/root/testdata/sf0.001").watched()
    full = windows.rolling_stats(watched, keys, EVENTS_SPEC)
    frame = windows.rolling_stats_rangeframe(watched, keys, EVENTS_SPEC)
    plain = lambda df: {tuple(r[k] for k in (*keys, "date_")): [
        None if v is None else round(float(v), 6) for c, v in r.asDict().items() if c not in (*keys, "date_")
    ] for r in df.collect()}
    a, b = plain(full), plain(frame)
    assert b and all(a[k] == b[k] for k in b)


def test_one_key_with_a_third_of_the_rows(spark):
    base = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("userid"),
        (F.col("id") % 97).alias("feedid"), (F.col("id") % 14 + 1).cast("int").alias("date_"),
        F.lit(1).alias("like"),
    )
    zero = {a: F.lit(0) for a in ACTIONS_ALL if a != "like"}
    df = base.withColumns({**zero, "play": F.lit(1.0), "stay": F.lit(1.0)})
    hot = windows.user_window_stats(df, SPEC).filter("userid = 0 AND date_ = 15").first()
    expected = df.filter("userid = 0 AND date_ BETWEEN 10 AND 14")
    assert hot["user_action_cnt"] == expected.count()
    assert hot["user_feed_cnt"] == expected.select("feedid").distinct().count()
