import pytest
from pyspark.sql import functions as F

from actionloom.operators.assemble import impute
from actionloom.plans.feature_build import run_feature_build
from actionloom.session import shared_dir
from actionloom.sources import tables as S
from actionloom.sources.bindings import EVENTS_SPEC, Tables
from actionloom.spec import FeatureSpec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def csv_dir(spark, tmp_path_factory):
    """The bound tables as headered CSV files, as they would arrive."""
    root = str(tmp_path_factory.mktemp("csv"))
    t = Tables(spark, SF)
    texts = {c: F.lit("some, text") for c in ("description", "ocr", "asr", "description_char", "ocr_char", "asr_char")}
    save = lambda df, name: df.write.option("header", True).csv(f"{root}/{name}")
    save(t.train().select("event_id", *S.INTERACTION_SCHEMA.fieldNames()), "interactions")
    save(t.items().withColumns(texts), "items")
    save(t.scoring().select("device", "userid", "feedid"), "scoring")
    return root


def test_csv_columns_go_by_name_and_type(spark, csv_dir):
    items = S.load(spark, f"{csv_dir}/items", S.ITEM_SCHEMA)
    assert [f.dataType for f in items.schema] == [f.dataType for f in S.ITEM_SCHEMA]
    key = ["feedid", "authorid", "videoplayseconds", "bgm_song_id", "manual_tag_list"]
    expected = Tables(spark, SF).items().select(*key)
    assert items.select(*key).exceptAll(expected).count() == 0 and items.count() == expected.count()
    scoring = S.load(spark, f"{csv_dir}/scoring", S.SCORING_SCHEMA, ["userid", "device"])
    assert scoring.columns == ["userid", "device"]
    assert scoring.agg(F.max("device")).first()[0] == 2


def test_missing_marks_and_bad_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("userid,feedid,device\n1,2.0,nan\n3,,1\n")
    rows = S.load(spark, str(tmp_path / "a.csv"), S.SCORING_SCHEMA).orderBy("userid").collect()
    assert [tuple(r) for r in rows] == [(1, 2, None), (3, None, 1)]
    (tmp_path / "b.csv").write_text("userid,feedid,device\n1,x2,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.load(spark, str(tmp_path / "b.csv"), S.SCORING_SCHEMA).collect()


def test_nan_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "feedid long, videoplayseconds double")
    df.write.parquet(str(tmp_path / "p"))
    schema = S.T.StructType([f for f in S.ITEM_SCHEMA if f.name in df.columns])
    loaded = S.load(spark, str(tmp_path / "p"), schema, fmt="parquet")
    assert loaded.agg(F.avg("videoplayseconds")).first()[0] == 3.0


def test_preflight(spark, csv_dir):
    expected = {
        "interactions": (f"{csv_dir}/interactions", ["userid", "feedid"]),
        "items": (f"{csv_dir}/items", ["feedid", "colour"]),
        "scoring": (f"{csv_dir}/nowhere", ["userid"]),
    }
    report = S.validate_sources(spark, expected, "csv")
    got = {r["name"]: (r["present"], r["missing_columns"]) for r in report.collect()}
    assert got == {"interactions": (True, ""), "items": (True, "colour"), "scoring": (False, "userid")}
    assert not S.sources_ready(report)
    assert S.sources_ready(S.validate_sources(spark, {"i": expected["interactions"]}, "csv"))


def test_submission_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.1234567), (3, 4, 1.0)], "userid long, feedid long, like double")
    S.write_submission(df, str(tmp_path / "s"), ["like"], run_id="r1")
    text = next((tmp_path / "s").glob("run_id=r1/*.csv")).read_text()
    assert text.startswith("userid,feedid,like\n")
    back = S.read_submission(spark, str(tmp_path / "s"), ["like"]).orderBy("userid").collect()
    assert [tuple(r) for r in back] == [(1, 2, 0.123457), (3, 4, 1.0)]


def test_feature_build_end_to_end(spark, csv_dir, tmp_path):
    out = str(tmp_path / "features")
    paths = {n: f"{csv_dir}/{n}" for n in ("interactions", "items", "scoring")}
    run_feature_build(spark, paths, out, EVENTS_SPEC)
    t = Tables(spark, SF)
    training = spark.read.parquet(f"{out}/training")
    assert training.count() == t.train().count()
    assert training.filter(F.col("user_action_cnt").isNull()).count() == 0
    assert spark.read.parquet(f"{out}/scoring").count() == t.scoring().count()
    assert spark.read.parquet(f"{out}/validation").count() == t.train().filter("date_ = 29").count()
    assert spark.read.parquet(f"{out}/user_tokens").count() == t.train().select("userid").distinct().count()
    with pytest.raises(FileNotFoundError):
        run_feature_build(spark, {**paths, "items": f"{csv_dir}/nowhere"}, out, EVENTS_SPEC)


def test_day_partitions_prune_files(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 14 + 1).cast("int").alias("date_"))
    S.write_table(df, str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).filter("date_ = 14")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date_" in plan


def test_impute(spark):
    df = spark.createDataFrame([(None, None, 3, None, None), (0, 1.0, None, 4, 2.5)],
                               "authorid long, videoplayseconds double, bgm_song_id long, bgm_singer_id long, s double")
    rows = [tuple(r) for r in impute(df, FeatureSpec(), ["s"]).collect()]
    assert rows[0] == (0, 0.0, 4, 0, 0.0)
    assert rows[1] == (1, pytest.approx(0.6931471805599453), 0, 5, 2.5)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured
