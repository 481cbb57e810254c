"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash.

Only built-in column functions are used. Two scans of the texts are made. The first
reduces them to counts per (length, prefix hash). What repeats there is kept as a bit
table of fixed size, and the second scan hashes the full content of rows whose bit is
set and of no others. The bit table can only let too many rows through, never too few,
so the groups do not depend on its size.

Defined results: a null text counts as empty, and all texts without a visible character
are equal. Of equal texts the row with most code points in the original text stays, then
the smallest id, null ids last, then the first stored row, so exactly one row of repeated
rows stays. An empty table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionloom.llm.common import SPACES, text_or_empty, unused_name
from actionloom.session import stored

PREFIX_CHARS = 64
#: Bits of the table of repeated (length, prefix hash) pairs: 2**22 bits are 512 KiB.
TABLE_BITS = 22


def without_spaces(text: Column) -> Column:
    """The text after deleting every space, tab, line feed, vertical tab, form feed, return."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _measured(docs: DataFrame, text_col: str, prefix_chars: int, *keep: Column) -> DataFrame:
    """``keep`` with _norm, _length, _prefix and the slot in the bit table."""
    norm = docs.select(*keep, without_spaces(text_or_empty(text_col)).alias("_norm"))
    measured = norm.select(
        "*", F.length("_norm").alias("_length"),
        F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix"))
    return measured.select(
        "*", F.pmod(F.xxhash64("_length", "_prefix"), F.lit(1 << TABLE_BITS)).alias("_slot"))


def repeated_prefixes(docs: DataFrame, text_col: str, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(_length, _prefix, _slot) of more than one row, among the lengths of more than one row."""
    counts = stored(
        _measured(docs, text_col, prefix_chars).groupBy("_length", "_prefix", "_slot")
        .agg(F.count(F.lit(1)).alias("_rows")))
    lengths = counts.groupBy("_length").agg(F.sum("_rows").alias("_same")).filter("_same > 1")
    return counts.join(lengths.select("_length"), "_length", "left_semi").filter("_rows > 1")


def _bit_table(pairs: DataFrame) -> DataFrame:
    """(_page, _bits): the slots of ``pairs``, at most 2**TABLE_BITS bits in pages of 4 KiB."""
    return pairs.groupBy(F.bitmap_bucket_number("_slot").alias("_page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))


def _bit_is_set() -> Column:
    position = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     row_col: str | None = None, carry: Sequence[str] = (),
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: id, ``_row``, keep_id, group_size, kept, and ``carry``.

    ``row_col`` names a unique row number that the input already stores; without it the
    rows are numbered here. Runs the two scans at once.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    keep = [F.col(id_col).alias("_id"), row.alias("_row"), F.length(text_or_empty(text_col)).alias("_points"),
            *[F.col(c) for c in carry]]
    pairs = repeated_prefixes(docs, text_col, prefix_chars)
    # Bounded by TABLE_BITS, whatever the input: 128 pages of 4 KiB.
    table = F.broadcast(_bit_table(pairs))
    measured = _measured(docs, text_col, prefix_chars, *keep).withColumn("_page", F.bitmap_bucket_number("_slot"))
    hashed = stored(measured.join(table, "_page", "left").select(
        "_id", "_row", "_points", *carry,
        F.when(_bit_is_set(), F.sha2(F.col("_norm").cast("binary"), 256)).alias("_full")))
    order = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"),
                     F.col("_id").alias("i"), F.col("_row").alias("r"))
    # Written first, so that both sides of the join are plain exchanges and a hot group is split.
    groups = stored(hashed.filter(F.col("_full").isNotNull()).groupBy("_full").agg(
        F.min(order).alias("_best"), F.count(F.lit(1)).alias("_size")))
    shared = hashed.join(groups, "_full").select(
        F.col("_id").alias(id_col), "_row", F.col("_best.i").alias("keep_id"),
        F.col("_size").alias("group_size"), (F.col("_row") == F.col("_best.r")).alias("kept"), *carry)
    alone = hashed.filter(F.col("_full").isNull()).select(
        F.col("_id").alias(id_col), "_row", F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carry)
    return shared.unionByName(alone)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    row = unused_name(docs, "_llm_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    dropped = stored(
        duplicate_groups(numbered, id_col, text_col, row_col=row).filter(~F.col("kept"))
        .select(F.col("_row").alias(row)))
    return numbered.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(text_col: str = "text") -> Column:
    """SHA-256 of the normalised text, as lowercase hex."""
    return F.sha2(without_spaces(text_or_empty(text_col)).cast("binary"), 256)
