"""The registered queries: every operator over the bound test tables.

Numbers are rounded here and not in the operators, lists are shown as text, so that
results can be compared between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionloom.functions.signals import watch_signals
from actionloom.functions.vectors import parse_vector, vector_summary
from actionloom.operators import assemble as A
from actionloom.operators import encode, evaluate, factors, globals_, models, reduce, sampling, tokens, windows
from actionloom.plans import training
from actionloom.plans.feature_build import build_features
from actionloom.plans.window_store import WindowStore
from actionloom.session import shared_dir, stored, tune
from actionloom.sources import tables as S
from actionloom.sources.bindings import EVENTS_SPEC, ORDERS_SPEC, VECTOR_LENGTH, Tables
from actionloom.spec import (
    ACTIONS_ALL, ACTIONS_FIRST_STAGE, EARLY_NEGATIVE_RATE, LATE_NEGATIVE_RATE, NEGATIVE_RATE,
    RECENT_FROM_DAY, ROLLING_KEY_SETS,
)

Query = Callable[[SparkSession, str], DataFrame]
SPEC = EVENTS_SPEC
FOLDS = 5
TIE_SHIFT = 1e-9
PROFILED = ("play", "stay", "device", *ACTIONS_ALL)
SCALED = ("play", "stay", "play_times", "videoplayseconds")
NUNIQUE_PAIRS = (
    ("userid", "feedid"), ("feedid", "userid"), ("userid", "authorid"), ("authorid", "userid"),
    ("feedid", "authorid"),
)
NARROWED = ("userid", "feedid", "authorid", "bgm_song_id", "device", "date_", "event_id",
            "videoplayseconds", "play")

_QUERIES: dict[str, Query] = {}


def query(run: Callable[[Tables], DataFrame], name: str | None = None) -> Callable[[Tables], DataFrame]:
    """Register a query over the bound tables, under its function's name by default."""
    _QUERIES[name or run.__name__] = lambda spark, sf_dir: run(Tables(tune(spark), sf_dir))
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Every double rounded, after a shift far below the last digit.

    Means of decimal values often fall exactly between two roundings, where the order of
    summation would decide; the shift moves them all to the same side. Adding zero turns
    a negative zero into a plain one.
    """
    return df.selectExpr(*[
        f"round(`{c}` + {TIE_SHIFT!r}D, {decimals}) + 0D AS `{c}`" if t == "double" else f"`{c}`"
        for c, t in df.dtypes
    ])


def _listed(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


# --- Scans, profile, formats -------------------------------------------------------

@query
def scan_interactions(t: Tables) -> DataFrame:
    return t.interactions()


@query
def scan_items(t: Tables) -> DataFrame:
    return t.items()


@query
def profile_interactions(t: Tables) -> DataFrame:
    return rounded(S.profile(t.interactions(), [*PROFILED, "userid", "feedid"], ["userid", "feedid"]), 4)


@query
def validate_sources(t: Tables) -> DataFrame:
    path = lambda name: f"{t.sf_dir}/{name}.parquet"
    return S.validate_sources(t.spark, {
        "events": (path("events"), ["event_id", "ts", "user_id", "event_type", "value", "props"]),
        "part": (path("part"), ["p_partkey", "p_brand", "p_size"]),
        "embeddings": (path("embeddings"), ["vec_id", "embedding"]),
        "lineitem": (path("lineitem"), ["l_orderkey", "l_partkey", "l_finish_rate"]),
        "side_table": (path("side_table"), ["userid"]),
    })


@query
def submission_format(t: Tables) -> DataFrame:
    return S.submission_rows(t.submission_per_pair(ACTIONS_FIRST_STAGE), ACTIONS_FIRST_STAGE)


@query
def submission_roundtrip(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/submission-{uuid.uuid4().hex}"
    S.write_submission(t.submission_per_pair(ACTIONS_FIRST_STAGE), path, ACTIONS_FIRST_STAGE)
    return S.read_submission(t.spark, path, ACTIONS_FIRST_STAGE)


# --- Filters, splits, unions -------------------------------------------------------

_ROW = ("event_id", "userid", "feedid", "date_")


@query
def split_by_day(t: Tables) -> DataFrame:
    earlier, validation = A.split_by_day(t.interactions(), SPEC)
    tagged = lambda df, part: df.select(*_ROW, F.lit(part).alias("part"))
    return tagged(earlier, "train").unionByName(tagged(validation, "validation"))


@query
def engaged_rows(t: Tables) -> DataFrame:
    return A.engaged(t.interactions(), ACTIONS_ALL).select(*_ROW)


def _all_rows(t: Tables) -> DataFrame:
    return A.union_scoring(t.train(), A.stamp_day(t.scoring(), SPEC))


@query
def union_train_scoring(t: Tables) -> DataFrame:
    return _all_rows(t)


@query
def split_by_label_presence(t: Tables) -> DataFrame:
    known, unknown = A.split_by_label(_all_rows(t), "read_comment")
    tagged = lambda df, part: df.select(*_ROW, "read_comment", F.lit(part).alias("part"))
    return tagged(known, "known").unionByName(tagged(unknown, "unknown"))


@query
def split_by_tag(t: Tables) -> DataFrame:
    train, score = A.split_by_tag(A.tag_union(t.train(), A.stamp_day(t.scoring(), SPEC)))
    per_part = lambda df, part: df.groupBy("userid").agg(
        F.count(F.lit(1)).alias("n"), F.count("play").alias("n_play")
    ).select(F.lit(part).alias("part"), "userid", "n", "n_play")
    return per_part(train, "train").unionByName(per_part(score, "score"))


@query
def recent_days(t: Tables) -> DataFrame:
    return A.recent(t.train(), RECENT_FROM_DAY, SPEC).select(*_ROW)


# --- Lists -------------------------------------------------------------------------

@query
def item_keyword_list(t: Tables) -> DataFrame:
    return tokens.item_token_lists(t.items()).select("feedid", _listed("feed_keyword_list"))


@query
def item_tag_list(t: Tables) -> DataFrame:
    return tokens.item_token_lists(t.items()).select("feedid", _listed("feed_tag_list"))


@query
def item_token_lists(t: Tables) -> DataFrame:
    return tokens.item_token_lists(t.items()).select(
        "feedid", _listed("feed_keyword_list"), _listed("feed_tag_list")
    )


def _user_lists(t: Tables) -> DataFrame:
    return tokens.user_token_lists(t.train(), tokens.item_token_lists(t.items()), SPEC)


@query
def user_token_lists(t: Tables) -> DataFrame:
    return _user_lists(t).select("userid", _listed("user_tag_list"), _listed("user_keyword_list"))


@query
def vocab_sizes(t: Tables) -> DataFrame:
    lists = tokens.item_token_lists(t.items())
    in_lists = tokens.vocab_sizes(lists, ["feed_keyword_list", "feed_tag_list"])
    in_items = tokens.vocab_sizes(t.items(), id_columns=["feedid", "authorid", "bgm_song_id", "bgm_singer_id"])
    in_log = tokens.vocab_sizes(t.interactions(), id_columns=["userid", "device"])
    return in_lists.unionByName(in_items).unionByName(in_log)


@query
def tag_multihot(t: Tables) -> DataFrame:
    return tokens.multihot(_user_lists(t), "userid", "user_tag_list", "user_tags_encode_list")


# --- Windows -----------------------------------------------------------------------

@query
def user_window_stats(t: Tables) -> DataFrame:
    return rounded(windows.user_window_stats(t.interactions(), SPEC))


@query
def item_window_stats(t: Tables) -> DataFrame:
    return rounded(windows.item_window_stats(t.interactions(), t.items(), SPEC))


def _rolling(keys: Sequence[str]) -> Callable[[Tables], DataFrame]:
    return lambda t: rounded(windows.rolling_stats(t.watched(), keys, SPEC))


ROLLING_QUERIES = {
    "rolling_stats_user": ("userid",),
    "rolling_stats_item": ("feedid",),
    "rolling_stats_author": ("authorid",),
    "rolling_stats_user_author": ("userid", "authorid"),
    "rolling_stats_song": ("bgm_song_id",),
}
for _name, _keys in ROLLING_QUERIES.items():
    query(_rolling(_keys), _name)


@query
def rolling_stats_rangeframe(t: Tables) -> DataFrame:
    return rounded(windows.rolling_stats_rangeframe(t.watched(), ["userid"], SPEC))


@query
def attach_rolling(t: Tables) -> DataFrame:
    history = stored(t.watched())
    rows = history.select("event_id", "userid", "feedid", "authorid", "date_")
    return rounded(A.attach_rolling(rows, history, ROLLING_KEY_SETS, SPEC))


#: Days that the incremental queries add one by one, after all days before them at once.
LAST_DAYS = 4


def _window_store(t: Tables, rolling: Sequence[Sequence[str]] = ()) -> WindowStore:
    store = WindowStore(t.spark, f"{shared_dir(t.spark)}/windows-{uuid.uuid4().hex}", SPEC, t.items(), rolling)
    log = t.watched() if rolling else t.interactions()
    first = SPEC.last_day - LAST_DAYS
    store.add(log.filter(F.col("date_") < first))
    for day in range(first, SPEC.last_day + 1):
        store.add(log.filter(F.col("date_") == day))
    return store


@query
def incremental_user_window_stats(t: Tables) -> DataFrame:
    return rounded(_window_store(t).user_stats())


@query
def incremental_item_window_stats(t: Tables) -> DataFrame:
    return rounded(_window_store(t).item_stats())


@query
def incremental_rolling_stats_author(t: Tables) -> DataFrame:
    return rounded(_window_store(t, [("authorid",)]).rolling_stats(("authorid",)))


@query
def rolling_stats_as_of(t: Tables) -> DataFrame:
    """Statistics of (user, author) for the days on which the pair has rows, from one sort."""
    log = t.watched()
    return rounded(windows.rolling_stats_as_of(log, log, ["userid", "authorid"], SPEC))


@partial(query, name="watch_signals")
def watch_signals_rows(t: Tables) -> DataFrame:
    return rounded(t.watched().select("event_id", "videoplayseconds", "is_finish", "play_times"))



# --- Whole-log statistics ----------------------------------------------------------

def _with_items(t: Tables) -> DataFrame:
    items = t.items().select("feedid", "authorid", "videoplayseconds")
    return watch_signals(A.attach(_all_rows(t), items, ["feedid"])).select(
        "event_id", "userid", "feedid", "authorid", "videoplayseconds"
    )


@query
def global_counts(t: Tables) -> DataFrame:
    return globals_.global_counts(_with_items(t), ["userid", "feedid", "authorid"])


@query
def global_nunique(t: Tables) -> DataFrame:
    return globals_.global_nunique(stored(_with_items(t)), NUNIQUE_PAIRS)


@query
def global_nunique_approx(t: Tables) -> DataFrame:
    return globals_.global_nunique(_with_items(t), NUNIQUE_PAIRS, approx=True)


@query
def pair_affinity(t: Tables) -> DataFrame:
    return rounded(globals_.pair_affinity(_with_items(t), "userid", "authorid"))


@query
def global_duration_means(t: Tables) -> DataFrame:
    rows = globals_.group_mean(_with_items(t), "videoplayseconds", "userid")
    return rounded(globals_.group_mean(rows, "videoplayseconds", "authorid"))


@query
def global_profile(t: Tables) -> DataFrame:
    return rounded(globals_.attach_global_profile(stored(_with_items(t)), SPEC))


# --- Assembly ----------------------------------------------------------------------

_SLIM = ("feedid", "authorid", "videoplayseconds", "bgm_song_id", "bgm_singer_id")


def _assembled(t: Tables) -> DataFrame:
    inter, items = t.interactions(), t.items().select(*_SLIM)
    return A.assemble(t.train(), items, windows.user_window_stats(inter, SPEC),
                      windows.item_window_stats(inter, items, SPEC), SPEC)


@query
def assemble_training(t: Tables) -> DataFrame:
    return rounded(_assembled(t))


@query
def assemble_scoring(t: Tables) -> DataFrame:
    inter, items = t.interactions(), t.items().select(*_SLIM)
    return rounded(A.assemble_scoring(
        t.scoring(), items, windows.user_window_stats(inter, SPEC),
        windows.item_window_stats(inter, items, SPEC), SPEC,
    ))


@query
def impute_features(t: Tables) -> DataFrame:
    return rounded(A.impute(_assembled(t), SPEC))


@query
def validation_features(t: Tables) -> DataFrame:
    return rounded(build_features(t.interactions(), t.items(), t.scoring(), SPEC).validation)


def _item_vectors(t: Tables) -> DataFrame:
    return t.packed_vectors().select(
        "feedid", parse_vector(F.col("feed_embedding"), VECTOR_LENGTH).alias("embedding")
    )


def _as_numbers(c: str) -> F.Column:
    return F.transform(c, lambda x: x.cast("double"))


@query
def assemble_embeddings(t: Tables) -> DataFrame:
    rows = A.attach(t.interactions().select(*_ROW), t.items().select(*_SLIM[:3]), ["feedid"])
    rows = A.attach(rows, _item_vectors(t), ["feedid"])
    rows = A.attach(rows, _user_lists(t).select("userid", "user_tag_list"), ["userid"])
    shown = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ")
    return rounded(rows.withColumn("embedding", shown).withColumn("user_tag_list", _listed("user_tag_list")))


def _side_tables(t: Tables, keep: bool = False) -> list[A.SideTable]:
    lists = tokens.item_token_lists(t.items())
    users = _user_lists(t)
    table = lambda df, key, column: df.select(key, _as_numbers(column).alias("v"))
    width = VECTOR_LENGTH if keep else 0
    return [
        A.SideTable(_item_vectors(t), "feedid", "embedding", "feed_embed", width),
        A.SideTable(table(lists, "feedid", "feed_tag_list"), "feedid", "v", "feed_tags"),
        A.SideTable(table(lists, "feedid", "feed_keyword_list"), "feedid", "v", "feed_kws"),
        A.SideTable(table(users, "userid", "user_tag_list"), "userid", "v", "user_tags"),
        A.SideTable(table(users, "userid", "user_keyword_list"), "userid", "v", "user_kws"),
    ]


@query
def assemble_side_tables(t: Tables) -> DataFrame:
    rows = A.attach(t.interactions().select(*_ROW), t.items().select(*_SLIM), ["feedid"])
    return rounded(A.attach_side_tables(rows, _side_tables(t)))


# --- Vectors -----------------------------------------------------------------------

@query
def parse_embedding(t: Tables) -> DataFrame:
    return _item_vectors(t).select(
        "feedid", F.size("embedding").alias("width"),
        F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("embedding"),
    )


@partial(query, name="vector_summary")
def vector_summary_rows(t: Tables) -> DataFrame:
    return rounded(t.raw("embeddings").select("vec_id", *vector_summary(F.col("embedding"), "v")))


@query
def vector_summary_compat(t: Tables) -> DataFrame:
    return rounded(t.raw("embeddings").select("vec_id", *vector_summary(F.col("embedding"), "v", compat=True)))



@query
def embedding_pca(t: Tables) -> DataFrame:
    rows = stored(factors.dense_rows(_item_vectors(t), "embedding", "feedid"))
    found = factors.factorise(rows, VECTOR_LENGTH, 32)
    return reduce.wide(factors.project(rows, found), "reduced", "embed", 32)


@query
def embedding_pca_moments(t: Tables) -> DataFrame:
    """What has to hold of the reduced vectors: as many as vectors, centred, with the variances
    that the fit claims, which fall and are part of the whole."""
    rows = stored(factors.dense_rows(_item_vectors(t), "embedding", "feedid"))
    found = factors.factorise(rows, VECTOR_LENGTH, 32)
    spread = factors.project(rows, found).select(F.posexplode("reduced").alias("place", "x")).groupBy("place").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    claimed = F.array(*[F.lit(float(v)) for v in found.variance])
    scale = float(found.variance[0]) if len(found.variance) else 1.0
    checked = spread.withColumn("fits", F.abs(F.col("variance") - F.get(claimed, "place")) < 1e-6 * scale).select(
        "place", "n", (F.abs("mean") < 1e-6 * max(scale, 1.0)).alias("centred"), "fits")
    whole = float(found.variance.sum() / found.share.sum()) if found.share.sum() else 0.0
    falling = bool((found.variance[1:] <= found.variance[:-1] + 1e-9 * scale).all())
    return rounded(checked.withColumns({"whole_variance": F.lit(whole), "falling": F.lit(falling)}), 3)


@query
def tags_pca_ratio(t: Tables) -> DataFrame:
    coded, vocabulary = tokens.token_codes(_user_lists(t), "userid", "user_tag_list")
    rows = stored(factors.sparse_rows(coded, "codes", "userid"))
    found, k = factors.factorise_to(rows, vocabulary.count(), 0.9)
    return reduce.wide(factors.project(rows, found, k), "reduced", "tags", k)


@query
def tag_multihot_sparse(t: Tables) -> DataFrame:
    rows, width = tokens.multihot_sparse(_user_lists(t), "userid", "user_tag_list", "tags")
    places = F.expr("filter(transform(x, (v, i) -> if(v = 1D, i, null)), i -> i IS NOT NULL)").cast("array<string>")
    return rows.withColumn("x", vector_to_array("tags")).select(
        "userid", F.lit(width).alias("width"), F.array_join(places, ",").alias("indices"))


TOKEN_WINDOW, TOKEN_SIZE = 5, 16
_TOKEN_LISTS = ("feed_tag_list", "feed_keyword_list", "user_tag_list", "user_keyword_list")


def _token_list(t: Tables, column: str) -> tuple[DataFrame, str]:
    """The table that has a list column, and its id."""
    if column.startswith("feed"):
        return tokens.item_token_lists(t.items()).select("feedid", column), "feedid"
    return _user_lists(t).select("userid", column), "userid"


@query
def token_ppmi(t: Tables) -> DataFrame:
    """Positive mutual information of the tokens of all four kinds of lists."""
    out = None
    for column in _TOKEN_LISTS:
        pairs, words = factors.positive_pmi(stored(_token_list(t, column)[0]), column, TOKEN_WINDOW)
        name = lambda side: words.select(F.col("code").alias(f"code_{side}"), F.col("token").alias(f"token_{side}"))
        named = pairs.join(name("a"), "code_a").join(name("b"), "code_b").select(
            F.lit(column).alias("list"), "token_a", "token_b", "ppmi")
        out = named if out is None else out.unionByName(named)
    return rounded(out)


@query
def token_embeddings(t: Tables) -> DataFrame:
    """Per kind of list and token: a vector from which tokens used alike can be told."""
    out = None
    for column in _TOKEN_LISTS:
        vectors = factors.token_embeddings(stored(_token_list(t, column)[0]), column, TOKEN_SIZE, TOKEN_WINDOW)
        named = vectors.select(F.lit(column).alias("list"), "token", F.size("embedding").alias("width"),
                               F.forall("embedding", lambda x: ~F.isnan(x)).alias("finite"))
        out = named if out is None else out.unionByName(named)
    return out


@query
def approx_user_window_items(t: Tables) -> DataFrame:
    """Different items per user and window, exact, and whether merged sketches are within 3 %."""
    log = t.interactions()
    near = windows.approx_distinct_of_sketches(windows.distinct_sketches(log, ["userid"], "feedid", SPEC), ["userid"], "near", SPEC)
    exact = windows.user_window_stats(log, SPEC).select("userid", "date_", "user_feed_cnt")
    within = F.abs(F.col("near") - F.col("user_feed_cnt")) <= F.col("user_feed_cnt") * 0.03
    return exact.join(near, ["userid", "date_"]).select("userid", "date_", "user_feed_cnt", within.alias("close"))


@query
def id_slots(t: Tables) -> DataFrame:
    """How many slots the ids of each column get, and where they begin."""
    rows = A.attach(t.train(), t.items().select("feedid", *_SLOT_ITEM_IDS), ["feedid"])
    slots = models.fit_id_slots(rows, _SLOT_IDS)
    sizes = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(slots.first[c]).alias("first"), F.lit(slots.codes[c].count()).alias("ids"))
        for c in _SLOT_IDS]))
    return t.spark.range(1).select(sizes)


_SLOT_ITEM_IDS = ("authorid", "bgm_song_id", "bgm_singer_id")
_SLOT_IDS = ("userid", "feedid", *_SLOT_ITEM_IDS, "device")


@query
def token_word2vec(t: Tables) -> DataFrame:
    embedded = reduce.token_word2vec(tokens.item_token_lists(t.items()), "feed_tag_list", 32)
    return reduce.wide(embedded.select("feedid", "embedding"), "embedding", "w2v", 32)


# --- Encoding and scaling ----------------------------------------------------------

def _id_rows(t: Tables) -> DataFrame:
    items = t.items().select("feedid", "authorid", "bgm_song_id")
    return A.attach(_all_rows(t).select("event_id", "userid", "feedid"), items, ["feedid"])


@query
def label_encode_numeric(t: Tables) -> DataFrame:
    rows = _id_rows(t)
    for c in ("userid", "feedid", "authorid"):
        rows = encode.label_encode(rows, c, "numeric", f"{c}_code")
    return rows.select("event_id", "userid_code", "feedid_code", "authorid_code")


@query
def label_encode_string(t: Tables) -> DataFrame:
    rows = _id_rows(t)
    for c in ("userid", "bgm_song_id"):
        rows = encode.label_encode(rows, c, "string", f"{c}_code")
    return rows.select("event_id", "userid_code", "bgm_song_id_code")


@query
def robust_scale(t: Tables) -> DataFrame:
    return rounded(encode.robust_scale(stored(t.watched().select("event_id", *SCALED)), SCALED))


@query
def winsor_minmax(t: Tables) -> DataFrame:
    return rounded(encode.winsor_minmax(stored(t.watched().select("event_id", *SCALED)), SCALED))


@query
def narrow_types(t: Tables) -> DataFrame:
    narrowed = encode.narrow_types(t.watched().select(*NARROWED), NARROWED)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(dtype).alias("dtype"), F.col(c).cast("double").alias("x"))
        for c, dtype in narrowed.dtypes
    ])
    return rounded(
        narrowed.select(F.inline(entries)).groupBy("column_name", "dtype").agg(F.sum("x").alias("total")), 2
    )


@query
def class_balance(t: Tables) -> DataFrame:
    return rounded(sampling.class_balance(t.train(), ACTIONS_ALL))


# --- Sampling ----------------------------------------------------------------------

@query
def neg_sample_exact(t: Tables) -> DataFrame:
    return sampling.negative_sample(t.train(), "like", NEGATIVE_RATE["like"], "event_id").select(*_ROW, "like")


@query
def neg_sample_bernoulli(t: Tables) -> DataFrame:
    return sampling.negative_sample_bernoulli(t.train(), "like", NEGATIVE_RATE["like"]).select(*_ROW, "like")


@query
def neg_sample_phase(t: Tables) -> DataFrame:
    return sampling.negative_sample_phase(
        t.train(), "click_avatar", EARLY_NEGATIVE_RATE["click_avatar"], LATE_NEGATIVE_RATE["click_avatar"],
        "event_id",
    ).select(*_ROW, "click_avatar")


@query
def neg_sample_stratified(t: Tables) -> DataFrame:
    return sampling.negative_sample_stratified(
        t.train(), "like", NEGATIVE_RATE["like"], "event_id"
    ).select(*_ROW, "like")


@query
def kfold_assign(t: Tables) -> DataFrame:
    return sampling.assign_folds(t.train(), FOLDS, "event_id").select("event_id", "fold")


@query
def dedup_keep_last(t: Tables) -> DataFrame:
    return sampling.keep_last(t.interactions(), ["userid", "feedid", "like"], ["date_", "event_id"])


# --- Evaluation --------------------------------------------------------------------

@query
def user_prediction_rank(t: Tables) -> DataFrame:
    rows = t.predictions(("read_comment", "forward")).select("event_id", "userid", "p_read_comment", "p_forward")
    rows = evaluate.average_rank(rows, ["userid"], "p_read_comment", "rank_read_comment")
    rows = evaluate.average_rank(rows, ["userid"], "p_forward", "rank_forward")
    return rows.select("event_id", "userid", "rank_read_comment", "rank_forward")


@query
def user_auc(t: Tables) -> DataFrame:
    return rounded(evaluate.user_auc(t.predictions(), ACTIONS_ALL))


@query
def uauc_by_action(t: Tables) -> DataFrame:
    return rounded(evaluate.uauc(t.predictions(), ACTIONS_ALL))


@query
def uauc_unrounded(t: Tables) -> DataFrame:
    return rounded(evaluate.uauc(t.predictions(), ACTIONS_FIRST_STAGE, decimals=None))


@query
def weighted_uauc(t: Tables) -> DataFrame:
    return evaluate.weighted_uauc(evaluate.uauc(t.predictions(), ACTIONS_FIRST_STAGE))


@query
def weighted_uauc_incomplete(t: Tables) -> DataFrame:
    """One action without any positive: there is no weighted score."""
    rows = t.predictions().filter(F.col("forward") == 0)
    return evaluate.weighted_uauc(evaluate.uauc(rows, ACTIONS_FIRST_STAGE))


@query
def score_submission(t: Tables) -> DataFrame:
    a = ACTIONS_FIRST_STAGE
    return evaluate.score_submission(t.submission_per_pair(a), t.labels_per_pair(a))


@query
def score_submission_all_actions(t: Tables) -> DataFrame:
    return evaluate.score_submission(
        t.submission_per_pair(ACTIONS_ALL), t.labels_per_pair(ACTIONS_ALL), "all"
    )


@query
def score_submission_bad_rows(t: Tables) -> DataFrame:
    a = ACTIONS_FIRST_STAGE
    result = t.submission_per_pair(a)
    return evaluate.score_submission(result.unionByName(result.filter(F.col("userid") == 1)), t.labels_per_pair(a))


@query
def score_submission_missing_cols(t: Tables) -> DataFrame:
    a = ACTIONS_FIRST_STAGE
    return evaluate.score_submission(t.submission_per_pair(a).drop("like", "forward"), t.labels_per_pair(a))


@query
def score_submission_bad_keys(t: Tables) -> DataFrame:
    a = ACTIONS_FIRST_STAGE
    shifted = t.submission_per_pair(a).withColumn("feedid", F.col("feedid") + 1)
    return evaluate.score_submission(shifted, t.labels_per_pair(a))


@query
def score_submission_bad_values(t: Tables) -> DataFrame:
    a = ACTIONS_FIRST_STAGE
    blank = t.submission_per_pair(a).withColumn(
        "like", F.when(F.col("userid") == 1, F.lit("n/a")).otherwise(F.col("like").cast("string"))
    )
    return evaluate.score_submission(blank, t.labels_per_pair(a))


@query
def ensemble_mean(t: Tables) -> DataFrame:
    a, keys = ACTIONS_FIRST_STAGE, ["userid", "feedid"]
    per_pair = lambda f: t.predictions(a).groupBy(*keys).agg(*[f(f"p_{x}").alias(x) for x in a])
    return rounded(models.ensemble_mean([per_pair(F.max), per_pair(F.min), per_pair(F.avg)], keys, a))


# --- The order tables as a larger log ----------------------------------------------

@query
def orders_user_window_stats(t: Tables) -> DataFrame:
    return rounded(windows.user_window_stats(t.order_log(), ORDERS_SPEC))


@query
def orders_item_window_stats(t: Tables) -> DataFrame:
    return rounded(windows.item_window_stats(t.order_log(), t.order_items(), ORDERS_SPEC))


@query
def orders_rolling_stats_author(t: Tables) -> DataFrame:
    return rounded(windows.rolling_stats(t.watched_orders(), ["authorid"], ORDERS_SPEC))


@query
def orders_pair_affinity(t: Tables) -> DataFrame:
    rows = globals_.pair_affinity(t.order_log().select("userid", "authorid"), "userid", "authorid")
    return rounded(rows.groupBy("authorid").agg(
        F.sum("userid_in_authorid_count_prop").alias("user_share"),
        F.sum("authorid_in_userid_count_prop").alias("author_share"), F.count(F.lit(1)).alias("n"),
    ))


@query
def orders_user_auc(t: Tables) -> DataFrame:
    return rounded(evaluate.user_auc(t.order_log(), ["like", "click_avatar"]))


# --- Models ------------------------------------------------------------------------
# The most trees that a job grows where the query does not take the operators' own, larger defaults.
_ROUNDS = 24
_TREES = dict(maxDepth=4)
_KEYS = ("userid", "feedid")


@query
def gbt_early_stop_refit(t: Tables) -> DataFrame:
    table = training.rolling_feature_table(t.interactions().filter(F.col("date_") < SPEC.last_day),
                                           t.scoring(), t.items(), SPEC)
    done = training.train_rolling_gbt(table, SPEC, extra_excluded=["event_id"])
    return done.submission


#: Rounds of the query that shows how the validation score moves with the number of trees.
CURVE_ROUNDS, CURVE_LEAST = 12, 0.6


@query
def gbt_prefix_uauc(t: Tables) -> DataFrame:
    """Per number of trees: the users that count, and whether their mean AUC shows the signal.

    Whether a view is finished follows from the watch time, which is among the features.
    """
    columns = ["play", "stay", "device"]
    rows = models.dense_features(t.watched().select("userid", "date_", "is_finish", *columns).fillna(0, subset=columns), columns)
    rows = stored(rows.select("userid", "date_", "is_finish", "features"))
    earlier, validation = A.split_by_day(rows, SPEC)
    with models.dealt(earlier.select("is_finish", "features")) as seen:
        model = models.fit_gbt(seen, "is_finish", CURVE_ROUNDS, **_TREES)
    curve = models.prefix_uauc(model, validation, "is_finish")
    return curve.select("trees", "users", (F.col("uauc") > CURVE_LEAST).alias("signal"),
                        F.col("uauc").between(0, 1).alias("in_range"))


@query
def gbt_weighted(t: Tables) -> DataFrame:
    done = training.train_staged_gbt(t.train(), t.scoring(), t.items(), SPEC, "online")
    return done.submission


@query
def gbt_weighted_offline(t: Tables) -> DataFrame:
    done = training.train_staged_gbt(t.train(), t.scoring(), t.items(), SPEC, "offline", _ROUNDS, **_TREES)
    return done.per_action


@query
def offline_submission_score(t: Tables) -> DataFrame:
    """The verdict on the written file of an offline run, but for the score itself."""
    done = training.train_staged_gbt(t.train(), t.scoring(), t.items(), SPEC, "offline", _ROUNDS, **_TREES)
    path = f"{shared_dir(t.spark)}/offline-{uuid.uuid4().hex}"
    verdict = training.offline_verdict(done, t.train(), path, SPEC)
    rows = S.read_submission(t.spark, path, ACTIONS_FIRST_STAGE)
    inside = F.lit(True)
    for a in ACTIONS_FIRST_STAGE:
        inside = inside & F.col(a).between(0, 1)
    seen = rows.agg(F.count(F.lit(1)).alias("pairs"), F.bool_and(inside).alias("probabilities"))
    pairs, probabilities = seen.first()
    return verdict.select("ret", "err_msg", F.col("score").between(0, 1).alias("scored"),
                          F.lit(pairs).cast("long").alias("pairs"), F.lit(probabilities).alias("probabilities"))


def _dense_table(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    """Imputed training and scoring rows with all window statistics as one vector."""
    built = build_features(t.train(), t.items(), t.scoring(), SPEC)
    columns = [*SPEC.user_columns(), *SPEC.item_columns(), "videoplayseconds", "device"]
    keep = [*_ROW, "features"]
    train = models.dense_features(built.training, columns).select(*keep, *ACTIONS_FIRST_STAGE)
    score = models.dense_features(built.scoring, columns).select(*keep)
    return stored(train), stored(score), columns


@query
def feature_importance_topk(t: Tables) -> DataFrame:
    train, _, columns = _dense_table(t)
    with models.dealt(train.select("like", "features")) as seen:
        return models.feature_importance(models.fit_gbt_weighted(seen, "like", _ROUNDS, **_TREES), columns)


def _learned_tables(t: Tables) -> list[A.SideTable]:
    """Item vectors, and the mean vectors of the tokens of items and users."""
    names = {"feed_tag_list": "feed_tags", "feed_keyword_list": "feed_kws",
             "user_tag_list": "user_tags", "user_keyword_list": "user_kws"}
    tables = [A.SideTable(_item_vectors(t), "feedid", "embedding", "feed_embed", VECTOR_LENGTH)]
    for column, prefix in names.items():
        lists, key = _token_list(t, column)
        vectors = stored(factors.list_embeddings(stored(lists), key, column, TOKEN_SIZE, TOKEN_WINDOW))
        tables.append(A.SideTable(vectors, key, "embedding", prefix, TOKEN_SIZE))
    return tables


def _mixed(t: Tables) -> tuple[DataFrame, DataFrame]:
    return training.side_table_features(
        t.train(), t.scoring(), t.items(), SPEC, _learned_tables(t), ["videoplayseconds"])





@query
def fm_classifier(t: Tables) -> DataFrame:
    train, score = _mixed(t)
    return training.train_side_table(train, score, SPEC, models.fit_fm).submission


@query
def fm_mlp_blend(t: Tables) -> DataFrame:
    train, score = _mixed(t)
    flat_train, flat_score, columns = _dense_table(t)
    fit_deep = models.network(len(columns))
    wide = training.train_side_table(train, score, SPEC, models.fit_fm).submission
    deep = models.multi_action_score(flat_train, flat_score, ACTIONS_FIRST_STAGE, fit_deep)
    return models.blend([wide, deep], _KEYS, ACTIONS_FIRST_STAGE)


@query
def joint_action_score(t: Tables) -> DataFrame:
    train, score, _ = _dense_table(t)
    return models.joint_action_score(train, score, ACTIONS_FIRST_STAGE).drop("features")


@query
def multi_action_score(t: Tables) -> DataFrame:
    train, score, _ = _dense_table(t)
    fit = lambda df, label: models.fit_gbt(df, label, _ROUNDS, **_TREES)
    with models.dealt(train.select(*ACTIONS_FIRST_STAGE, "features")) as seen:
        return models.multi_action_score(seen, score, ACTIONS_FIRST_STAGE, fit).drop("features")


@query
def kfold_ensemble(t: Tables) -> DataFrame:
    train, score = _mixed(t)
    return training.train_side_table(
        train, score, SPEC, models.fit_fm, k=3, row_id="event_id"
    ).submission


@query
def model_blend(t: Tables) -> DataFrame:
    train, score = _mixed(t)
    flat_train, flat_score, _ = _dense_table(t)
    fit_trees = lambda df, label: models.fit_gbt(df, label, _ROUNDS, **_TREES)
    wide = training.train_side_table(train, score, SPEC, models.fit_fm).submission
    with models.dealt(flat_train.select(*ACTIONS_FIRST_STAGE, "features")) as seen:
        trees = models.multi_action_score(seen, flat_score, ACTIONS_FIRST_STAGE, fit_trees)
    return models.blend([wide, trees], _KEYS, ACTIONS_FIRST_STAGE, [0.4, 0.6])
