"""Row-level numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def round_half_even(c: Column, decimals: int) -> Column:
    """Round by scaling, ties to the even neighbour of the scaled value."""
    scale = float(10**decimals)
    return F.rint(c.cast("double") * scale) / scale


def any_action(actions: Sequence[str]) -> Column:
    """Whether one of the flags is set; a missing flag is not."""
    acted = F.lit(False)
    for a in actions:
        acted = acted | (F.coalesce(F.col(a), F.lit(0)) != 0)
    return acted


def watch_signals(df: DataFrame) -> DataFrame:
    """Duration from seconds to milliseconds, then ``is_finish`` and ``play_times``.

    A missing play time or duration is not finished; a zero duration has no ratio.
    """
    play, duration = F.col("play"), F.col("videoplayseconds") * 1000
    return (
        df.withColumn("videoplayseconds", duration)
        .withColumn("is_finish", F.coalesce(play >= F.col("videoplayseconds"), F.lit(False)).cast("int"))
        .withColumn("play_times", F.try_divide(play, F.col("videoplayseconds")))
    )
