"""Tag and keyword lists of items and users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionloom.functions.lists import merge_keywords, merge_tags
from actionloom.functions.signals import any_action
from actionloom.functions.vectors import sparse_struct, stored_vectors
from actionloom.operators.ordering import ordered_codes
from actionloom.operators.windows import attach
from actionloom.spec import TAG_THRESHOLD, FeatureSpec


def item_token_lists(items: DataFrame, threshold: float = TAG_THRESHOLD, item: str = "feedid") -> DataFrame:
    """(item, feed_keyword_list, feed_tag_list), both from one scan of the items."""
    return items.select(
        item,
        merge_keywords(F.col("manual_keyword_list"), F.col("machine_keyword_list")).alias("feed_keyword_list"),
        merge_tags(F.col("manual_tag_list"), F.col("machine_tag_list"), threshold).alias("feed_tag_list"),
    )


def user_token_lists(inter: DataFrame, lists: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(user, user_tag_list, user_keyword_list): tokens of the items a user acted on.

    Every user of the log appears, with empty lists if there was no action. Log rows are
    reduced to (user, item) pairs before the join, and tokens to distinct ones before
    they are collected, so a list is at most as long as the vocabulary.
    """
    pairs = inter.groupBy(spec.user, spec.item).agg(F.bool_or(any_action(spec.actions)).alias("_acted"))
    tokens = lambda c, kind: F.transform(
        F.coalesce(F.col(c), F.array().cast("array<int>")),
        lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")),
    )
    both = F.when(
        F.col("_acted"), F.concat(tokens("feed_tag_list", "tag"), tokens("feed_keyword_list", "keyword"))
    )
    distinct = (
        attach(pairs, lists, [spec.item])
        .select(spec.user, F.explode_outer(both).alias("_t"))
        .select(spec.user, "_t.kind", "_t.token")
        .distinct()
    )
    gathered = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("token"))))
    return distinct.groupBy(spec.user).agg(
        gathered("tag").alias("user_tag_list"), gathered("keyword").alias("user_keyword_list")
    )


def vocab_sizes(df: DataFrame, list_columns: Sequence[str] = (), id_columns: Sequence[str] = ()) -> DataFrame:
    """(column, bound, n_distinct): largest id plus one, and the number of different ids."""
    as_ids = lambda c: F.transform(F.col(c), lambda x: x.cast("long"))
    entries = [F.struct(F.lit(c).alias("column"), as_ids(c).alias("ids")) for c in list_columns]
    entries += [
        F.struct(F.lit(c).alias("column"), F.array(F.col(c).cast("long")).alias("ids")) for c in id_columns
    ]
    ids = df.select(F.inline(F.array(*entries))).select("column", F.explode("ids").alias("id"))
    return (
        ids.filter(F.col("id").isNotNull()).distinct()
        .groupBy("column")
        .agg((F.max("id") + 1).alias("bound"), F.count("id").alias("n_distinct"))
    )


def token_codes(df: DataFrame, id_column: str, list_column: str) -> tuple[DataFrame, DataFrame]:
    """((id, sorted codes) for every id, the vocabulary with its codes)."""
    exploded = df.select(id_column, F.explode_outer(list_column).alias("token"))
    vocabulary = ordered_codes(exploded, "token", "code")
    coded = (
        attach(exploded.distinct(), vocabulary, ["token"])
        .groupBy(id_column).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    )
    return coded, vocabulary


def _dense_text(codes: Column, width: Column) -> Column:
    """Zeros and ones separated by blanks, written run by run between the set positions."""
    zeros = lambda n: F.repeat(F.lit("0 "), n.cast("int"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(codes, i - 1))
    ones = F.transform(codes, lambda c, i: F.concat(zeros(c - before(i) - 1), F.lit("1 ")))
    last = F.coalesce(F.array_max(codes), F.lit(-1))
    return F.rtrim(F.concat(F.array_join(ones, ""), zeros(width - last - 1)))


def multihot(df: DataFrame, id_column: str, list_column: str, name: str) -> DataFrame:
    """(id, name): one 0/1 per vocabulary entry, entries in ascending order.

    The text is as long as the vocabulary; for vocabularies beyond a few thousand use the
    codes of :func:`token_codes` as a sparse form.
    """
    coded, vocabulary = token_codes(df, id_column, list_column)
    # Width travels as a column: subqueries are not allowed inside list functions.
    width = vocabulary.agg(F.count(F.lit(1)).alias("width")).scalar()
    return coded.withColumn("_width", width).select(
        id_column, _dense_text(F.col("codes"), F.col("_width")).alias(name)
    )


def multihot_vectors(df: DataFrame, id_column: str, list_column: str, name: str) -> DataFrame:
    """(id, name) with the 0/1 entries as an array of doubles."""
    text = multihot(df, id_column, list_column, "_text")
    return text.select(
        id_column, F.transform(F.split("_text", " "), lambda x: x.cast("double")).alias(name)
    )


def multihot_sparse(df: DataFrame, id_column: str, list_column: str, name: str) -> tuple[DataFrame, int]:
    """((id, ``name`` as a sparse vector of ones), the width), stored.

    The width is the vocabulary's size, entries ascend with the tokens, and a row costs as much
    as its list is long, whatever the vocabulary.
    """
    coded, vocabulary = token_codes(df, id_column, list_column)
    width = vocabulary.count()
    ones = F.transform("codes", lambda _: F.lit(1.0))
    return stored_vectors(coded.select(id_column, sparse_struct(width, F.col("codes"), ones).alias(name)), name), width
