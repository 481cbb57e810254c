"""Reading and writing the tables of the feature build."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionloom.functions.signals import null_if_nan
from actionloom.operators.ordering import exact_quantiles
from actionloom.session import discard, stored_with

INTERACTION_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("userid", "feedid")]
    + [T.StructField(c, T.IntegerType()) for c in ("date_", "device")]
    + [T.StructField(c, T.IntegerType()) for c in ("read_comment", "comment", "like")]
    + [T.StructField(c, T.DoubleType()) for c in ("play", "stay")]
    + [T.StructField(c, T.IntegerType()) for c in ("click_avatar", "forward", "follow", "favorite")]
)
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("feedid", T.LongType()),
        T.StructField("authorid", T.LongType()),
        T.StructField("videoplayseconds", T.DoubleType()),
    ]
    + [T.StructField(c, T.StringType()) for c in ("description", "ocr", "asr")]
    + [T.StructField(c, T.LongType()) for c in ("bgm_song_id", "bgm_singer_id")]
    + [
        T.StructField(c, T.StringType())
        for c in ("manual_keyword_list", "machine_keyword_list", "manual_tag_list", "machine_tag_list",
                  "description_char", "ocr_char", "asr_char")
    ]
)
SCORING_SCHEMA = T.StructType([
    T.StructField("userid", T.LongType()), T.StructField("feedid", T.LongType()),
    T.StructField("device", T.IntegerType()),
])
EMBEDDING_SCHEMA = T.StructType([
    T.StructField("feedid", T.LongType()), T.StructField("feed_embedding", T.StringType()),
])


# Texts that stand for a missing value in a CSV file.
_MISSING_TEXTS = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None")


def _typed(text: Column, target: T.DataType) -> Column:
    """A CSV text as ``target``; anything but a number or a missing mark is an error."""
    known = F.when(~F.trim(text).isin(*_MISSING_TEXTS), text)
    if isinstance(target, (T.LongType, T.IntegerType)):
        # Whole numbers may have been written with a fraction, as in 12.0.
        return F.when(known.rlike(r"^\s*-?\d+\s*$"), known.cast(target)).otherwise(
            known.cast("double").cast(target)
        )
    return known.cast(target)


def load(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None,
         fmt: str = "csv") -> DataFrame:
    """A table with a fixed schema, cut to ``columns``; not-a-number becomes null.

    CSV columns are found by their header names, in whatever order the file has them.
    """
    fields = [f for f in schema.fields if columns is None or f.name in columns]
    if fmt == "csv":
        text = spark.read.option("header", True).option("escape", '"').csv(path)
        return text.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    fractional = (T.FloatType, T.DoubleType)
    return spark.read.schema(schema).format(fmt).load(path).select(*[
        (null_if_nan(F.col(f.name)) if isinstance(f.dataType, fractional) else F.col(f.name)).alias(f.name)
        for f in fields
    ])


def validate_sources(spark: SparkSession, expected: Mapping[str, tuple[str, Sequence[str]]],
                     fmt: str = "parquet", with_counts: bool = True) -> DataFrame:
    """(name, present, missing_columns, row_count) for every expected source.

    Only ``row_count`` needs a scan; without ``with_counts`` it is NULL and schemas decide.

    ``expected`` maps a name to its path and the columns it must have. A source that
    cannot be read is reported, not raised.
    """
    parts = []
    for name, (path, columns) in expected.items():
        try:
            source = spark.read.format(fmt).option("header", True).load(path)
        except AnalysisException:
            parts.append(_source_row(spark.range(0), name, False, columns, with_counts))
            continue
        absent = [c for c in columns if c not in source.columns]
        parts.append(_source_row(source, name, True, absent, with_counts))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def _source_row(source: DataFrame, name: str, present: bool, absent: Sequence[str],
                with_counts: bool) -> DataFrame:
    one_row = source.agg(F.count(F.lit(1)).alias("row_count")) if with_counts else \
        source.sparkSession.range(1).select(F.lit(None).cast("long").alias("row_count"))
    return one_row.select(
        F.lit(name).alias("name"), F.lit(present).alias("present"),
        F.lit(",".join(absent)).alias("missing_columns"), "row_count",
    )


def sources_ready(report: DataFrame) -> bool:
    """Whether every source is present and complete; one flag comes back to the driver."""
    ok = F.bool_and(F.col("present") & (F.col("missing_columns") == ""))
    return bool(report.agg(ok.alias("ok")).first()["ok"])


def profile(df: DataFrame, columns: Sequence[str], id_columns: Sequence[str] = ()) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max, n_distinct).

    Quartiles are exact and interpolated; ``n_distinct`` is filled for the id columns. The
    named columns are stored once, however the input is made; counts and moments are taken
    while they are written. A column without values gives no row.
    """
    used = list(dict.fromkeys([*columns, *id_columns]))
    number = {c: F.col(c).cast("double") for c in columns}
    known = {c: F.when(~F.isnan(x), x) for c, x in number.items()}
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    kept, seen = stored_with(df.select(*used), {
        f"{name}:{i}": measure(x) for i, x in enumerate(known.values()) for name, measure in moments.items()})
    quartiles = exact_quantiles(kept, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    distinct = {}
    if id_columns:
        counts = kept.agg(*[F.count_distinct(F.col(c)).alias(c) for c in id_columns]).first()
        distinct = counts.asDict()
    discard(kept)
    names = ("count", "mean", "std", "min", "q25", "q50", "q75", "max", "n_distinct")
    rows = []
    for i, c in enumerate(columns):
        one = {name: seen[f"{name}:{i}"] for name in moments} | quartiles[c] | {"n_distinct": distinct.get(c)}
        if one["count"]:
            rows.append((c, *[one[n] for n in names]))
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, "
        "max double, n_distinct long")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("date_",),
                run_id: str | None = None) -> None:
    """Parquet partitioned by day, so day predicates prune files; optionally by run."""
    parts = list(partition_by)
    if run_id is not None:
        df, parts = df.withColumn("run_id", F.lit(run_id)), ["run_id", *parts]
    # Rows of a day meet in a few tasks, which Spark splits by size: few and even files.
    df.hint("rebalance", *[F.col(p) for p in parts]).write.mode("overwrite").partitionBy(*parts).parquet(path)


def submission_rows(df: DataFrame, actions: Sequence[str], decimals: int | None = 6) -> DataFrame:
    """Keys and one prediction per action, as fixed-point text when ``decimals`` is set."""
    shown = lambda a: F.format_string(f"%.{decimals}f", F.col(a)) if decimals is not None else F.col(a)
    return df.select("userid", "feedid", *[shown(a).alias(a) for a in actions])


def write_submission(df: DataFrame, path: str, actions: Sequence[str], decimals: int | None = 6,
                     run_id: str | None = None) -> None:
    rows = submission_rows(df, actions, decimals)
    writer = rows if run_id is None else rows.withColumn("run_id", F.lit(run_id))
    out = writer.write.mode("overwrite").option("header", True)
    (out.partitionBy("run_id") if run_id is not None else out).csv(path)


def read_submission(spark: SparkSession, path: str, actions: Sequence[str]) -> DataFrame:
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("userid", "feedid")]
        + [T.StructField(a, T.DoubleType()) for a in actions]
    )
    return load(spark, path, schema)
