"""Sliding day-window statistics: for target day t, the days t-n .. t-1.

One pass serves every target day. Rows are first reduced to (key, day) partials behind a
map-side combine: a key that holds a third of the log arrives as one row per map task and
day. The partials, at most one per key and day, are then moved to their key's partition
and fanned out there, so the fan-out is never shuffled and no key makes a large partition.

Distinct counts do not add up over days, so they travel as bitmaps of covered target
days per (key, value) pair: one shuffle of the pairs, whatever the window width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionloom.session import input_bytes
from actionloom.spec import FeatureSpec

_MASK_BITS = 60


def _feeds_a_target(spec: FeatureSpec) -> Column:
    day = F.col(spec.day)
    return (day + 1 <= spec.last_day) & (day + spec.n_day >= spec.first_target)


def _target_range(spec: FeatureSpec) -> tuple[Column, Column]:
    day = F.col(spec.day)
    return (
        F.greatest(day + 1, F.lit(spec.first_target)),
        F.least(day + spec.n_day, F.lit(spec.last_day)),
    )


def explode_target_days(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Repeat every row once per target day it feeds; ``spec.day`` becomes that day."""
    low, high = _target_range(spec)
    rows = df.filter(_feeds_a_target(spec)).withColumns({"_from": low, "_to": high})
    return _fan_out(rows, spec)


def _fan_out(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per target day ``_from .. _to``."""
    others = [c for c in rows.columns if c not in (spec.day, "_from", "_to")]
    return rows.select(*others, F.explode(F.sequence("_from", "_to")).alias(spec.day))


#: Bytes of input files behind a partition that is fanned out; the fan-out takes some hundred times as much memory.
_FILE_BYTES = 4 << 20


def _at_keys(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``partials`` moved to their keys, to be fanned out there.

    The partitions grow in number with the files that are read, not in size: the groups of the
    fan-out lie in a task's memory, and shuffles of packed rows say little of them.
    """
    parts = input_bytes(partials) // _FILE_BYTES
    if parts < 2:
        return partials.repartition(*keys)
    return partials.repartition(max(partials.sparkSession.sparkContext.defaultParallelism, parts), *keys)


def covered_spans(df: DataFrame, keys: Sequence[str], value: str, spec: FeatureSpec) -> DataFrame:
    """(keys, _from, _to): for every distinct ``value`` the runs of target days whose window has it.

    Rows with a null key are left out. The distinct (keys, value) rows are planned alike whichever
    of the columns is the value, so that one exchange of them serves both directions.
    """
    low, high = _target_range(spec)
    first = F.lit(spec.first_target)
    known, both = _feeds_a_target(spec), sorted([*keys, value])
    for c in both:
        known = known & F.col(c).isNotNull()
    rows = df.filter(known).select(
        *both, (low - first).alias("_lo"), (high - first).alias("_hi")
    )
    n_blocks = (spec.last_day - spec.first_target) // _MASK_BITS + 1
    if n_blocks == 1:
        rows = rows.withColumn("_block", F.lit(0))
    else:
        # A row near the end of a block also covers days of the next one.
        block_of = lambda c: F.floor(F.col(c) / _MASK_BITS).cast("int")
        rows = rows.withColumn("_block", F.explode(F.sequence(block_of("_lo"), block_of("_hi"))))
    mask = F.expr(
        f"shiftleft(1L, least(_hi - _block * {_MASK_BITS}, {_MASK_BITS - 1}) + 1)"
        f" - shiftleft(1L, greatest(_lo - _block * {_MASK_BITS}, 0))"
    )
    pairs = rows.groupBy(*both, "_block").agg(F.bit_or(mask).alias("_mask"))
    begins, ends = "_mask & ~shiftleft(_mask, 1)", "_mask & ~shiftright(_mask, 1)"
    bits = lambda mask: f"filter(sequence(0, {_MASK_BITS - 1}), i -> getbit({mask}, i) = 1)"
    lowest = "cast(bit_count((_mask & -_mask) - 1L) AS int)"
    # Nearly every mask is one run, which needs no list of its bits.
    runs = (
        f"CASE WHEN bit_count({begins}) = 1 THEN array(struct({lowest} AS _b, {lowest} + cast(bit_count(_mask) AS int) - 1 AS _e))"
        f" ELSE zip_with({bits(begins)}, {bits(ends)}, (b, e) -> struct(b AS _b, e AS _e)) END")
    day_of = lambda c: (first + F.col("_block") * _MASK_BITS + F.col(c)).cast("int")
    return pairs.select(*keys, "_block", F.inline(F.expr(runs))).select(
        *keys, day_of("_b").alias("_from"), day_of("_e").alias("_to"))


def covered_targets(df: DataFrame, keys: Sequence[str], value: str, spec: FeatureSpec) -> DataFrame:
    """(keys, target day) once for every distinct ``value`` seen in that day's window."""
    return _fan_out(covered_spans(df, keys, value, spec), spec)


def _day_partials(df: DataFrame, keys: Sequence[str], columns: Sequence[str], maxima: Sequence[str],
                  spec: FeatureSpec) -> DataFrame:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    # Sums and non-null counts, so that means can be merged.
    measures = ["count(1) AS _rows"]
    for c in columns:
        measures += [f"sum(`{c}`) AS `_s_{c}`", f"count(`{c}`) AS `_n_{c}`"]
    measures += [f"max(`{c}`) AS `_m_{c}`" for c in maxima]
    return df.filter(_feeds_a_target(spec) & known).groupBy(*keys, spec.day).agg(*map(F.expr, measures))


# Measures are SQL text, with an optional window: a wide list of them is built in one go.

def _sum(c: str, over: str = "") -> str:
    """A sum that is 0, not null, for a window without values."""
    return f"cast(coalesce(sum(`_s_{c}`){over}, 0) AS bigint)"


def _mean(c: str, over: str = "") -> str:
    return f"try_divide(cast(sum(`_s_{c}`){over} AS double), sum(`_n_{c}`){over})"


#: Per entity: how its columns begin, and the names of its row count and distinct count.
_ENTITIES = {"user": ("user", ("user_action_cnt", "user_feed_cnt")), "item": ("feed", ("feed_expo_cnt", "feed_user_cnt"))}


def _sides(entity: str, spec: FeatureSpec) -> tuple[str, str]:
    """The key of an entity and what it is paired with."""
    return (spec.user, spec.item) if entity == "user" else (spec.item, spec.user)


def entity_day_partials(inter: DataFrame, entity: str, spec: FeatureSpec) -> DataFrame:
    """Sums and counts per (key, day), for the days that feed a target day."""
    key, other = _sides(entity, spec)
    measured = ["play", "stay", *spec.actions]
    present = F.col(other).isNotNull().cast("long")
    rows = inter.select(key, other, spec.day, *measured, present.alias("_present"))
    return _day_partials(rows, [key], [*measured, "_present"], [], spec)


def entity_stats_of_partials(partials: DataFrame, pairs: DataFrame, entity: str, spec: FeatureSpec) -> DataFrame:
    """Window statistics from ``entity_day_partials`` and (user, item, day) rows, repeated or not."""
    key, other = _sides(entity, spec)
    prefix, counts = _ENTITIES[entity]
    low, high = _target_range(spec)
    sums = partials.filter(_feeds_a_target(spec)).withColumns({"_from": low, "_to": high}).drop(spec.day)
    distinct = covered_spans(pairs, [key], other, spec).groupBy(key, "_from", "_to").agg(
        F.count(F.lit(1)).alias("_distinct"))
    # Both are down to one row per key and span of days: stacked, moved to their key, fanned out.
    both = _at_keys(sums.unionByName(distinct, allowMissingColumns=True), [key])
    measures = [
        f"{_sum('_present')} AS {counts[0]}",
        f"coalesce(sum(_distinct), 0) AS {counts[1]}",
        f"{_mean('play')} AS {prefix}_play_avg",
        f"{_mean('stay')} AS {prefix}_stay_avg",
        *[f"{_sum(a)} AS `{prefix}_{a}_sum`" for a in spec.actions],
        *[f"{_mean(a)} AS `{prefix}_{a}_avg`" for a in spec.actions],
    ]
    return _fan_out(both, spec).groupBy(key, spec.day).agg(*map(F.expr, measures))


def _entity_window_stats(df: DataFrame, entity: str, spec: FeatureSpec) -> DataFrame:
    return entity_stats_of_partials(entity_day_partials(df, entity, spec), df, entity, spec)


def with_watch_rates(stats: DataFrame, items: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Item statistics with the two rates that compare watch time with duration."""
    durations = items.select(spec.item, spec.duration)
    rate = lambda c: F.try_divide(F.col(c) / 1000, F.col(spec.duration))
    return (
        stats.join(durations, spec.item, "left")
        .withColumn("feed_play_rate", rate("feed_play_avg"))
        .withColumn("feed_stay_rate", rate("feed_stay_avg"))
        .drop(spec.duration)
    )


def user_window_stats(inter: DataFrame, spec: FeatureSpec) -> DataFrame:
    """18 measures per (user, target day)."""
    return _entity_window_stats(inter, "user", spec)


def item_window_stats(inter: DataFrame, items: DataFrame, spec: FeatureSpec) -> DataFrame:
    """20 measures per (item, target day); the two rates compare watch time with duration."""
    return with_watch_rates(_entity_window_stats(inter, "item", spec), items, spec)


#: Logarithm of the registers of a sketch: 2**14 give an error of about 0.8 %.
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame, keys: Sequence[str], value: str, spec: FeatureSpec,
                      bits: int = SKETCH_BITS) -> DataFrame:
    """(keys, day, sketch): one mergeable sketch of the different values per key and day."""
    known = F.col(value).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return df.filter(known).groupBy(*keys, spec.day).agg(F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def approx_distinct_of_sketches(sketches: DataFrame, keys: Sequence[str], name: str, spec: FeatureSpec) -> DataFrame:
    """(keys, target day, name): estimated numbers of different values in each window.

    Distinct counts do not add up over days, but the days' sketches do: they are a bounded size
    and can be kept, so neither the log nor its distinct pairs are read for a new window.
    """
    fanned = explode_target_days(_at_keys(sketches, keys), spec)
    return fanned.groupBy(*keys, spec.day).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


_WATCHED = ("play_times", "play", "stay")


def rolling_prefix(keys: Sequence[str], spec: FeatureSpec) -> str:
    return f"{'_'.join(keys)}_{spec.n_day}day"


def rolling_columns(keys: Sequence[str], spec: FeatureSpec) -> list[str]:
    p = rolling_prefix(keys, spec)
    return (
        [f"{p}_count", f"{p}_finish_rate"]
        + [f"{p}_{x}_{s}" for x in _WATCHED for s in ("max", "mean")]
        + [f"{p}_{a}_{s}" for a in spec.rolling_actions for s in ("sum", "mean")]
    )


def _rolling_measures(keys: Sequence[str], spec: FeatureSpec, over: str = "") -> list[str]:
    p = rolling_prefix(keys, spec)
    out = [f"sum(_rows){over} AS {p}_count", f"{_mean('is_finish', over)} AS {p}_finish_rate"]
    for x in _WATCHED:
        out += [f"max(_m_{x}){over} AS {p}_{x}_max", f"{_mean(x, over)} AS {p}_{x}_mean"]
    for a in spec.rolling_actions:
        out += [f"{_sum(a, over)} AS `{p}_{a}_sum`", f"{_mean(a, over)} AS `{p}_{a}_mean`"]
    return out


def rolling_day_partials(df: DataFrame, keys: Sequence[str], spec: FeatureSpec) -> DataFrame:
    """Sums, counts and maxima per (keys, day), for the days that feed a target day."""
    return _day_partials(df, keys, ["is_finish", *_WATCHED, *spec.rolling_actions], _WATCHED, spec)


def rolling_stats(df: DataFrame, keys: Sequence[str], spec: FeatureSpec) -> DataFrame:
    """16 measures per (keys, target day) over watch signals and actions."""
    return rolling_stats_of_partials(rolling_day_partials(df, keys, spec), keys, spec)


def rolling_stats_of_partials(partials: DataFrame, keys: Sequence[str], spec: FeatureSpec) -> DataFrame:
    """The same from ``rolling_day_partials``, of which only the days that feed a target are used."""
    fanned = explode_target_days(_at_keys(partials, keys), spec)
    return fanned.groupBy(*keys, spec.day).agg(*map(F.expr, _rolling_measures(keys, spec)))


def _range_frame(keys: Sequence[str], spec: FeatureSpec) -> str:
    return (
        f" OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{spec.day}`"
        f" RANGE BETWEEN {spec.n_day} PRECEDING AND 1 PRECEDING)"
    )


def rolling_stats_as_of(history: DataFrame, probes: DataFrame, keys: Sequence[str],
                        spec: FeatureSpec) -> DataFrame:
    """The 16 measures for the (keys, day) combinations of ``probes`` only, as of that day.

    ``history`` holds the rows that are counted, ``probes`` the days that are asked for; each
    is reduced to one row per key and day in the same exchange. Nothing is fanned out: a
    range frame over a key's days sees the days before each probe. A key has at most one row
    per day, so a hot key is no large window group. A probe without a row in its window gives
    no row, and neither does a day beyond the target days.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    columns = ["is_finish", *_WATCHED, *spec.rolling_actions]
    counted = history.filter(_feeds_a_target(spec) & known).select(
        *keys, spec.day, *columns, F.lit(1).alias("_counted"))
    asked = probes.filter(F.col(spec.day).between(spec.first_target, spec.last_day) & known).select(
        *keys, spec.day, F.lit(1).alias("_asked"))
    measures = ["count(_counted) AS _rows", "max(_asked) AS _asked"]
    measures += [m for c in columns for m in (f"sum(`{c}`) AS `_s_{c}`", f"count(`{c}`) AS `_n_{c}`")]
    measures += [f"max(`{c}`) AS `_m_{c}`" for c in _WATCHED]
    days = counted.unionByName(asked, allowMissingColumns=True).groupBy(*keys, spec.day).agg(*map(F.expr, measures))
    return (
        days.selectExpr(*keys, spec.day, "_asked", *_rolling_measures(keys, spec, _range_frame(keys, spec)))
        .filter(F.col("_asked").isNotNull() & (F.col(f"{rolling_prefix(keys, spec)}_count") > 0))
        .drop("_asked")
    )


def rolling_stats_rangeframe(df: DataFrame, keys: Sequence[str], spec: FeatureSpec) -> DataFrame:
    """The same measures as a range frame, for days on which the key is active itself.

    Enough to look features up for log rows. The frame runs over day partials, at most
    one row per key and day, so no key makes a large window group.
    """
    frame = _range_frame(keys, spec)
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    last_rows = df.filter((F.col(spec.day) == spec.last_day) & known).select(*keys, spec.day).distinct()
    days = rolling_day_partials(df, keys, spec).unionByName(last_rows, allowMissingColumns=True)
    return (
        days.selectExpr(*keys, spec.day, *_rolling_measures(keys, spec, frame))
        .filter(F.col(f"{rolling_prefix(keys, spec)}_count").isNotNull()
                & (F.col(spec.day) >= spec.first_target))
    )


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join per-key statistics; rows with a null key keep null statistics.

    ``stats`` has one row per key. The join strategy is left to the optimizer, which
    broadcasts only below its size limit and splits hot keys otherwise.
    """
    return df.join(stats, list(keys), "left")
