"""Building the training, validation and scoring tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionloom.functions.signals import any_action
from actionloom.functions.vectors import vector_summary
from actionloom.operators.windows import attach, rolling_stats_as_of
from actionloom.spec import ITEM_ID_COLUMNS, FeatureSpec


@dataclass(frozen=True)
class SideTable:
    """A per-key vector table: where it is joined and how its columns are named."""

    table: DataFrame
    key: str
    vector: str
    prefix: str
    keep: int = 0


def assemble(rows: DataFrame, items: DataFrame, user_stats: DataFrame, item_stats: DataFrame,
             spec: FeatureSpec) -> DataFrame:
    """Rows with item attributes and the window statistics of their own day."""
    out = attach(rows, items, [spec.item])
    out = attach(out, user_stats, [spec.user, spec.day])
    return attach(out, item_stats, [spec.item, spec.day])


def assemble_scoring(scoring: DataFrame, items: DataFrame, user_stats: DataFrame, item_stats: DataFrame,
                     spec: FeatureSpec) -> DataFrame:
    """The scoring set stamped with the last day, with that day's statistics only."""
    stamped = stamp_day(scoring, spec)
    on_last_day = F.col(spec.day) == spec.last_day
    return assemble(stamped, items, user_stats.filter(on_last_day), item_stats.filter(on_last_day), spec)


def stamp_day(scoring: DataFrame, spec: FeatureSpec) -> DataFrame:
    return scoring.withColumn(spec.day, F.lit(spec.last_day))


def impute(df: DataFrame, spec: FeatureSpec, stat_columns: Sequence[str] | None = None,
           id_columns: Sequence[str] = ITEM_ID_COLUMNS) -> DataFrame:
    """Missing statistics become 0, ids move up by one with 0 for unknown, duration is logged."""
    stats = spec.user_columns() + spec.item_columns() if stat_columns is None else list(stat_columns)
    df = df.fillna(0, subset=stats) if stats else df
    shifted = {c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("long") for c in id_columns}
    logged = F.log1p(F.coalesce(F.col(spec.duration), F.lit(0.0)).cast("double"))
    return df.withColumns({**shifted, spec.duration: logged})


def attach_rolling(rows: DataFrame, history: DataFrame, key_sets: Sequence[Sequence[str]],
                   spec: FeatureSpec, asked: DataFrame | None = None) -> DataFrame:
    """Join the rolling statistics of every key set to the rows' own day.

    Statistics are made for the days on which a key has rows, not for every day it could.
    ``asked`` has the rows' keys and days, by default ``rows`` itself; give a stored table where
    ``rows`` has joins behind it, as every key set reads it anew.
    """
    probes = (rows if asked is None else asked).select(spec.day, *dict.fromkeys(k for keys in key_sets for k in keys))
    for keys in key_sets:
        rows = attach(rows, rolling_stats_as_of(history, probes, keys, spec), [*keys, spec.day])
    return rows


def attach_side_tables(df: DataFrame, tables: Sequence[SideTable]) -> DataFrame:
    """Join vector tables; each adds the average, maximum and sum of its vector.

    A table with ``keep`` set also adds the vector, of that many entries, under its
    prefix. Numbers still missing afterwards become 0, missing vectors zeros.
    """
    for t in tables:
        kept = [F.col(t.vector).alias(t.prefix)] if t.keep else []
        df = attach(df, t.table.select(t.key, *kept, *vector_summary(F.col(t.vector), t.prefix)), [t.key])
    zeros = {
        t.prefix: F.coalesce(F.col(t.prefix), F.array_repeat(F.lit(0.0), t.keep)) for t in tables if t.keep
    }
    return df.withColumns(zeros).fillna(0) if zeros else df.fillna(0)


def union_scoring(train: DataFrame, scoring: DataFrame) -> DataFrame:
    """Stack training and scoring rows; columns one side lacks are null there."""
    return train.unionByName(scoring, allowMissingColumns=True)


def tag_union(train: DataFrame, scoring: DataFrame, tag: str = "split") -> DataFrame:
    """Stack with an explicit origin column, so the parts can be told apart again."""
    return union_scoring(
        train.withColumn(tag, F.lit("train")), scoring.withColumn(tag, F.lit("score"))
    )


def split_by_tag(df: DataFrame, tag: str = "split") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(tag) == "train").drop(tag), df.filter(F.col(tag) == "score").drop(tag)


def split_by_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known label, and rows to be scored."""
    return df.filter(F.col(label).isNotNull()), df.filter(F.col(label).isNull())


def split_by_day(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """Days before the validation day, and the validation day."""
    day = F.col(spec.day)
    return df.filter(day < spec.validation_day), df.filter(day == spec.validation_day)


def recent(df: DataFrame, min_day: int, spec: FeatureSpec) -> DataFrame:
    return df.filter(F.col(spec.day) >= min_day)


def engaged(df: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Rows with at least one action."""
    return df.filter(any_action(actions))


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]
