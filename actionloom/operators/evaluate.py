"""Per-user AUC with average ranks for ties, and what is built on it.

A user may own any share of the predictions, so no step puts all rows of a user into one
task. Rows are reduced to counts per (group, score); scores fall into fixed slices; ranks
are taken inside a slice and shifted by what lies in the slices below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actionloom.functions.signals import round_half_even
from actionloom.operators.ordering import range_slices
from actionloom.spec import ACTION_WEIGHTS, ACTIONS_ALL, ACTIONS_FIRST_STAGE, SCORE_DECIMALS

_SLICES_PER_UNIT = 1000


def _score_slice(score: str) -> Column:
    """A slice number that grows with the score.

    Scores rounded to six decimals have at most a thousand values in a slice, and a
    probability has at most a thousand and one slices.
    """
    return F.floor(F.col(score) * _SLICES_PER_UNIT)


def _sliced(counted: DataFrame, by: Sequence[str], score: str, decimals: int | None) -> DataFrame:
    """Distinct (by, score) rows with a ``_slice`` that grows with the score in a group."""
    if decimals is None:
        return range_slices(counted, [*by, score], "_slice")
    return counted.withColumn("_slice", _score_slice(score))


def long_predictions(df: DataFrame, actions: Sequence[str], user: str = "userid",
                     score_prefix: str = "p_", decimals: int | None = SCORE_DECIMALS) -> DataFrame:
    """(user, action, label, score), one row per log row and action."""
    scored = lambda a: F.col(f"{score_prefix}{a}").cast("double")
    rounded = (lambda a: round_half_even(scored(a), decimals)) if decimals is not None else scored
    entries = F.array(*[
        F.struct(F.lit(a).alias("action"), F.col(a).cast("int").alias("label"), rounded(a).alias("score"))
        for a in actions
    ])
    return df.select(user, F.inline(entries))


def group_auc(long: DataFrame, by: Sequence[str], decimals: int | None = SCORE_DECIMALS) -> DataFrame:
    """(by, n_pos, n_neg, auc) from (by, label, score); ``auc`` is null for one class only.

    With ``decimals`` the scores are taken as already rounded and sliced by value. With
    None they may be any doubles, and the slices come from a range partitioning of the
    distinct (group, score) rows, which is balanced whatever the skew.
    """
    counted = long.groupBy(*by, "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("_pos"),
        F.sum((F.col("label") != 1).cast("long")).alias("_neg"),
    )
    sliced = _sliced(counted, by, "score", decimals)
    below = W.partitionBy(*by, "_slice").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    inside = sliced.withColumn(
        "_won", F.col("_pos") * (F.coalesce(F.sum("_neg").over(below), F.lit(0)) + F.col("_neg") / 2)
    )
    slices = inside.groupBy(*by, "_slice").agg(
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.sum("_won").alias("_won")
    )
    lower = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # Products of counts are taken as doubles: they outgrow a long on large logs.
    won = F.col("_won") + F.col("_pos").cast("double") * F.coalesce(F.sum("_neg").over(lower), F.lit(0))
    return (
        slices.select(*by, "_pos", "_neg", won.alias("_won"))
        .groupBy(*by)
        .agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum("_won").alias("_won"))
        .select(
            *by, "n_pos", "n_neg",
            F.try_divide(F.col("_won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
        )
    )


def average_rank(df: DataFrame, by: Sequence[str], score: str, name: str = "rank",
                 decimals: int | None = SCORE_DECIMALS) -> DataFrame:
    """Add the 1-based rank of ``score`` within ``by``; ties share their average rank.

    ``decimals`` as in :func:`group_auc`: None for scores that are not rounded.
    """
    counted = _sliced(df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n")), by, score, decimals)
    slices = counted.groupBy(*by, "_slice").agg(F.sum("_n").alias("_slice_n"))
    lower = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select(
        *by, "_slice", F.coalesce(F.sum("_slice_n").over(lower), F.lit(0)).alias("_offset")
    )
    below = W.partitionBy(*by, "_slice").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    ranks = (
        counted.join(offsets, [*by, "_slice"])
        .withColumn("_below", F.col("_offset") + F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .select(*by, score, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    )
    return df.join(ranks, [*by, score], "left")


def user_auc(df: DataFrame, actions: Sequence[str], user: str = "userid",
             decimals: int | None = SCORE_DECIMALS) -> DataFrame:
    """(user, action, n_pos, n_neg, auc); all actions in one job."""
    return group_auc(long_predictions(df, actions, user, decimals=decimals), [user, "action"], decimals)


def uauc(df: DataFrame, actions: Sequence[str], user: str = "userid",
         decimals: int | None = SCORE_DECIMALS) -> DataFrame:
    """(action, users, uauc): the mean over the users that have both classes."""
    return user_auc(df, actions, user, decimals).groupBy("action").agg(
        F.count("auc").alias("users"), F.avg("auc").alias("uauc")
    )


def weighted_uauc(per_action: DataFrame, weights: Mapping[str, float] | None = None,
                  actions: Sequence[str] | None = None) -> DataFrame:
    """One row ``score``: the weighted mean of ``uauc`` over the rows, to six decimals.

    NULL unless every row has a ``uauc`` and a weight and, where ``actions`` are given, each of
    them has a row. Without them the mean is over the actions that are there.
    """
    weight_of = F.create_map(*[
        F.lit(x) for pair in (weights or ACTION_WEIGHTS).items() for x in pair
    ])
    weighted = per_action.withColumn("_w", weight_of[F.col("action")].cast("double"))
    known = F.bool_and(F.col("uauc").isNotNull() & F.col("_w").isNotNull())
    if actions is not None:
        known = known & (F.count_distinct(F.when(F.col("action").isin(*actions), F.col("action"))) == len(set(actions)))
    mean = F.sum(F.col("_w") * F.col("uauc")) / F.sum("_w")
    return weighted.agg(F.when(known, F.round(mean, SCORE_DECIMALS)).alias("score"))


def score_submission(result: DataFrame, label: DataFrame, mode: str = "first") -> DataFrame:
    """Check a submission against the labels and score it: one row with
    ``ret, err_msg, score`` and one ``uauc_{action}`` per action.

    ret 1: row counts differ; 2: columns missing; 3: the keys do not match one to one in
    number; 4: the values cannot be scored; 0: scored. ``mode`` is "first" for four
    actions or "all" for seven.
    """
    actions = {"first": ACTIONS_FIRST_STAGE, "all": ACTIONS_ALL}[mode]
    keys = ["userid", "feedid"]
    spark = label.sparkSession
    absent_labels = [c for c in [*keys, *actions] if c not in label.columns]
    if absent_labels:
        return _verdict(spark.range(1), F.lit(4), F.lit(f"label columns missing: {', '.join(absent_labels)}"), actions)

    # Ids that are no numbers are missing ids: their rows match nothing.
    label, result = (
        df.withColumns({k: F.col(k).try_cast("long") for k in keys if k in df.columns}) for df in (label, result)
    )
    absent = [c for c in [*keys, *actions] if c not in result.columns]
    # Three numbers, counted once: the checks, the guard of the join and the message all need them.
    counted = _match_sizes(result, label, [k for k in keys if k not in absent])
    found = counted.first()
    sizes = spark.createDataFrame([found], counted.schema)
    if absent:
        missing = F.lit(f"columns missing in the result: {', '.join(absent)}")
        unequal = F.col("n_result") != F.col("n_label")
        return _verdict(
            sizes, F.when(unequal, F.lit(1)).otherwise(F.lit(2)),
            F.when(unequal, _unequal_rows()).otherwise(missing), actions,
        )

    # Pairs are formed only once the counts say that they number exactly one per label,
    # so repeated keys on both sides can not multiply.
    matched = F.lit(found["n_result"] == found["n_label"] == found["n_pairs"])
    labels = label.select(*keys, *[F.col(a).try_cast("int").alias(a) for a in actions])
    scores = result.select(*keys, *[F.col(a).try_cast("double").alias(f"p_{a}") for a in actions])
    joined = labels.filter(matched).join(scores.filter(matched), keys)
    per_user = group_auc(
        long_predictions(joined, actions).withColumn(
            "label", F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.col("label"))
        ),
        ["userid", "action"],
    )
    # A row without a usable label or score is neither class; its group then falls short.
    totals = (
        per_user.groupBy().pivot("action", list(actions))
        .agg(F.avg("auc").alias("uauc"), F.sum(F.col("n_pos") + F.col("n_neg")).alias("usable"))
    )
    both = sizes.unionByName(totals, allowMissingColumns=True)
    checked = both.agg(*[F.max(c).alias(c) for c in both.columns])
    usable, scorable = F.lit(True), F.lit(True)
    for a in actions:
        usable = usable & (F.coalesce(F.col(f"{a}_usable"), F.lit(0)) == F.col("n_label"))
        scorable = scorable & F.col(f"{a}_uauc").isNotNull()
    ret = (
        F.when(F.col("n_result") != F.col("n_label"), 1)
        .when(F.col("n_pairs") != F.col("n_label"), 3)
        .when(~usable | ~scorable, 4)
        .otherwise(0)
    )
    message = (
        F.when(F.col("n_result") != F.col("n_label"), _unequal_rows())
        .when(F.col("n_pairs") != F.col("n_label"), F.lit("userid-feedid pairs differ from the label set"))
        .when(~usable, F.lit("a label or prediction is missing or not a number"))
        .when(~scorable, F.lit("an action has no user with both classes"))
    )
    total_weight = sum(ACTION_WEIGHTS[a] for a in actions)
    weighted = sum((F.col(f"{a}_uauc") * ACTION_WEIGHTS[a] for a in actions), F.lit(0.0)) / total_weight
    return _verdict(checked, ret, message, actions, weighted)


def _match_sizes(result: DataFrame, label: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows on either side and the number of pairs an inner join would give."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = label.select(*keys, one.alias("_l"), none.alias("_r")).unionByName(
        result.select(*keys, none.alias("_l"), one.alias("_r"))
    )
    per_key = sides.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    pairs = F.when(F.lit(True) if not keys else _all_known(keys),
                   F.col("_l").cast("decimal(38,0)") * F.col("_r")).otherwise(F.lit(0))
    return per_key.agg(
        F.coalesce(F.sum("_l"), none).alias("n_label"),
        F.coalesce(F.sum("_r"), none).alias("n_result"),
        F.coalesce(F.sum(pairs), F.lit(0)).alias("n_pairs"),
    )


def _all_known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def _unequal_rows() -> Column:
    return F.format_string("the result has %d rows, the label set %d", F.col("n_result"), F.col("n_label"))


def _verdict(one_row: DataFrame, ret: Column, message: Column, actions: Sequence[str],
             score: Column | None = None) -> DataFrame:
    ok = ret == 0
    rounded = lambda c: F.when(ok, F.round(c, SCORE_DECIMALS)).cast("double")
    nothing = F.lit(None).cast("double")
    return one_row.select(
        ret.cast("int").alias("ret"),
        message.cast("string").alias("err_msg"),
        (rounded(score) if score is not None else nothing).alias("score"),
        *[
            (rounded(F.col(f"{a}_uauc")) if score is not None else nothing).alias(f"uauc_{a}")
            for a in actions
        ],
    )
