"""From feature tables to scored submissions: three training jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionloom.functions.signals import watch_signals
from actionloom.operators.assemble import (
    SideTable, attach_rolling, attach_side_tables, feature_columns, split_by_label, split_by_day, split_by_tag,
    stamp_day, tag_union, union_scoring,
)
from actionloom.operators.encode import label_encode, robust_scale
from actionloom.operators.evaluate import score_submission, uauc, weighted_uauc
from actionloom.operators.globals_ import attach_global_profile
from actionloom.operators.models import (
    Fit, dealt, dense_features, ensemble_mean, filled_vectors, fit_fm, fit_gbt, fit_gbt_early_stop, fit_gbt_weighted, fit_id_slots,
    kfold_ensemble, mixed_features, multi_action_score, predict, side_by_side,
    slot_features,
)
from actionloom.operators.sampling import (
    assign_folds, negative_sample, negative_sample_phase, negative_sample_stratified,
)
from actionloom.operators.windows import attach
from actionloom.session import stored
from actionloom.sources.tables import read_submission, write_submission
from actionloom.spec import (
    ACTIONS_FIRST_STAGE, EARLY_NEGATIVE_RATE, LATE_NEGATIVE_RATE, NEGATIVE_RATE, ROLLING_KEY_SETS, FeatureSpec,
)

_WATCH = ("is_finish", "play_times", "play", "stay")


Sampling = Callable[[DataFrame, str], DataFrame]


def sampled_rows(mode: str, row_id: str | Sequence[str], first_day: int | None = None,
                 day: str = "date_") -> Sampling:
    """Training rows of an action: "full", "exact", "phase" or "stratified" by the fixed
    rates, from ``first_day`` on."""
    def sample(df: DataFrame, action: str) -> DataFrame:
        rows = df if first_day is None else df.filter(F.col(day) >= first_day)
        if mode == "full":
            return rows
        if mode == "exact":
            return negative_sample(rows, action, NEGATIVE_RATE[action], row_id)
        if mode == "phase":
            return negative_sample_phase(rows, action, EARLY_NEGATIVE_RATE[action], LATE_NEGATIVE_RATE[action],
                                         row_id, day)
        if mode == "stratified":
            return negative_sample_stratified(rows, action, NEGATIVE_RATE[action], row_id)
        raise ValueError("mode must be full, exact, phase or stratified")
    return sample


@dataclass
class Scored:
    """Predictions for the scoring set, and the offline quality where it was measured."""

    submission: DataFrame
    per_action: DataFrame | None = None
    weighted: DataFrame | None = None


def rolling_feature_table(inter: DataFrame, scoring: DataFrame, items: DataFrame, spec: FeatureSpec,
                          item_vectors: DataFrame | None = None, user_vectors: DataFrame | None = None,
                          global_profile: bool = True) -> DataFrame:
    """Training and scoring rows with item attributes, vectors, rolling and global statistics."""
    rows = union_scoring(inter, stamp_day(scoring, spec))
    rows = attach(rows, items.select(spec.item, spec.author, spec.duration), [spec.item])
    rows = stored(watch_signals(rows))  # read by every statistic below
    history = rows.filter(F.col(spec.day) < spec.last_day)
    out = rows
    for vectors, key in ((item_vectors, spec.item), (user_vectors, spec.user)):
        if vectors is not None:
            out = attach(out, vectors, [key])
    if not global_profile:
        return attach_rolling(out, history, ROLLING_KEY_SETS, spec)
    # Every join moves the rows with all that they have by then: the few global columns are attached before the many
    # rolling ones, and take their place behind them.
    plain = out
    out = attach_global_profile(plain, spec)
    profile = [c for c in out.columns if c not in plain.columns]
    out = attach_rolling(out, history, ROLLING_KEY_SETS, spec, asked=plain)
    return out.select(*[c for c in out.columns if c not in profile], *profile)


def train_rolling_gbt(table: DataFrame, spec: FeatureSpec, max_iter: int = 100,
                      actions: Sequence[str] = ACTIONS_FIRST_STAGE, extra_excluded: Sequence[str] = (),
                      patience: int = 20, every: int = 1, **params) -> Scored:
    """Trees that stop early by the mean AUC of a user on the validation day, refitted on all
    labelled rows with as many, applied to the rows without a label.

    ``patience`` rounds without a gain end the search; ``every`` tells how many rounds apart
    the validation day is looked at.
    """
    excluded = [spec.day, *_WATCH, *spec.actions, *extra_excluded]
    columns = feature_columns(table, excluded)
    vectors = [c for c in columns if table.schema[c].dataType.typeName() == "array"]
    numbers = [c for c in columns if c not in vectors]
    prepared = stored(dense_features(filled_vectors(table.fillna(0, subset=numbers), vectors), columns).select(
        spec.user, spec.item, spec.day, *actions, "features"
    ))
    train, score = split_by_label(prepared, actions[0])
    _, validation = split_by_day(train, spec)
    submission = score.drop(*actions)
    with dealt(train.select(spec.user, spec.day, *actions, "features")) as rows:
        def both(action: str) -> tuple[Model, Model]:
            stopped, trees = fit_gbt_early_stop(rows, action, spec, max_iter, patience, every=every, **params)
            return stopped, fit_gbt(rows, action, trees, **params)

        for action, (stopped, final) in zip(actions, side_by_side(rows, [partial(both, a) for a in actions])):
            validation = predict(stopped, validation, f"p_{action}")
            submission = predict(final, submission, action)
    # Tree predictions are compared as they are, not rounded to submission decimals.
    per_action = uauc(validation, actions, spec.user, decimals=None)
    return Scored(submission.select(spec.user, spec.item, *actions), per_action,
                  weighted_uauc(per_action, actions=actions))


def side_table_features(inter: DataFrame, scoring: DataFrame, items: DataFrame, spec: FeatureSpec,
                        side_tables: Sequence[SideTable],
                        dense: Sequence[str], buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, score) with ids, robust-scaled dense columns and vector columns.

    Every id of either part has a slot of its own; with ``buckets`` ids are hashed to so many.
    Kept vectors enter unscaled.
    """
    ids = [spec.user, spec.item, spec.author, "bgm_song_id", "bgm_singer_id", "device"]
    rows = tag_union(inter, stamp_day(scoring, spec))
    rows = attach(rows, items.select(spec.item, spec.duration, *ids[2:5]), [spec.item])
    rows = attach_side_tables(rows, side_tables)
    summaries = [f"{t.prefix}_{s}" for t in side_tables for s in ("avg", "max", "sum")]
    scaled = [*dense, *summaries]
    # Stored once: scaling reads it several times, and every fit starts from it.
    table = stored(rows.withColumns({c: F.col(c).cast("double") for c in scaled}))
    vectors = {t.prefix: t.keep for t in side_tables if t.keep}
    prepared = robust_scale(table, scaled)
    if buckets is not None:
        return split_by_tag(mixed_features(prepared, ids, scaled, list(vectors), buckets))
    return split_by_tag(slot_features(prepared, fit_id_slots(table, ids), scaled, vectors))


def train_side_table(train: DataFrame, score: DataFrame, spec: FeatureSpec, fit: Fit = fit_fm, k: int = 0,
                     row_id: str | None = None, actions: Sequence[str] = ACTIONS_FIRST_STAGE,
                     sample: Sampling | None = None, stage: str = "online") -> Scored:
    """One model per action, or the mean of ``k`` fold models.

    ``sample`` thins the training rows of each action, such as ``sampled_rows`` does.
    ``stage`` "offline" holds out the validation day, measures on it, and scores it.
    """
    keys = [spec.user, spec.item]
    if sample is not None:
        full_fit = fit
        fit = lambda df, label: full_fit(sample(df, label), label)
    if stage == "offline":
        earlier, validation = split_by_day(train, spec)
        measured = multi_action_score(earlier, validation, actions, fit, "p_")
        per_action = uauc(measured, actions, spec.user, decimals=None)
        submission = measured.select(*keys, *[F.col(f"p_{a}").alias(a) for a in actions])
        return Scored(submission, per_action, weighted_uauc(per_action, actions=actions))
    bare = score.drop(*actions)
    if k:
        folds = assign_folds(train, k, row_id)
        return Scored(kfold_ensemble(folds, bare, actions, k, fit, keys))
    return Scored(multi_action_score(train, bare, actions, fit).select(*keys, *actions))


def offline_verdict(done: Scored, labels: DataFrame, path: str, spec: FeatureSpec,
                    actions: Sequence[str] = ACTIONS_FIRST_STAGE) -> DataFrame:
    """Write an offline submission as it would be handed in, read it back, and score the file.

    A pair that occurs several times on the validation day has the mean of its predictions and
    every action that occurred. The result is the one row of ``score_submission``.
    """
    keys = [spec.user, spec.item]
    _, held = split_by_day(labels, spec)
    truth = held.groupBy(*keys).agg(*[F.max(a).alias(a) for a in actions])
    write_submission(ensemble_mean([done.submission], keys, actions), path, actions)
    handed_in = read_submission(labels.sparkSession, path, actions)
    return score_submission(handed_in, truth, "first" if len(actions) == len(ACTIONS_FIRST_STAGE) else "all")


def train_staged_gbt(inter: DataFrame, scoring: DataFrame, items: DataFrame, spec: FeatureSpec, stage: str,
                     max_iter: int = 200, actions: Sequence[str] = ACTIONS_FIRST_STAGE, **params) -> Scored:
    """Class-weighted trees on encoded ids. ``stage`` "offline" fits the days before the
    validation day and measures on it; "online" fits all days and scores the scoring set."""
    if stage not in ("offline", "online"):
        raise ValueError("stage must be offline or online")
    ids = [spec.user, spec.item, spec.author, "bgm_song_id", "bgm_singer_id", "device"]
    rows = attach(tag_union(inter, stamp_day(scoring, spec)),
                  items.select(spec.item, spec.duration, *ids[2:5]), [spec.item])
    for c in ids:
        rows = label_encode(rows, c, "string", f"_code_{c}")
    columns = [*[f"_code_{c}" for c in ids], spec.duration]
    prepared = stored(dense_features(rows.fillna(0, subset=columns), columns))
    train, score = split_by_tag(prepared)
    fit = lambda df, label: fit_gbt_weighted(df, label, max_iter, **params)
    keys = [spec.user, spec.item]
    if stage == "online":
        with dealt(train.select(*actions, "features")) as seen:
            return Scored(multi_action_score(seen, score.drop(*actions), actions, fit).select(*keys, *actions))
    earlier, validation = split_by_day(train, spec)
    with dealt(earlier.select(*actions, "features")) as seen:
        measured = multi_action_score(seen, validation, actions, fit, "p_")
    per_action = uauc(measured, actions, spec.user, decimals=None)
    submission = measured.select(*keys, *[F.col(f"p_{a}").alias(a) for a in actions])
    return Scored(submission, per_action, weighted_uauc(per_action, actions=actions))
