"""Contiguous shards of nearly equal byte size, cut along global prefix sums.

The documents are put into one total order. Each partition of that order adds up its sizes;
the totals of the partitions give every partition its start, and with it every document its
place on a line as long as all sizes together. The line is cut into equal stretches, and a
document belongs to the stretch that holds its middle byte. So each cut lies at the document
boundary nearest to its target, and a shard differs from the target by less than the larger
of the two documents at its ends, whatever the number of documents. Only ids, sizes and
checksums are moved; one count and one sum per partition reach the driver, and one row per
shard is broadcast.

Defined results: a null text has no bytes, and each row adds ``OVERHEAD``. Rows are ordered by
id (null first), then checksum and size; rows equal in all three are interchangeable, so the
result does not depend on how the table is stored. Repeated rows are rows of their own. A
document longer than a whole stretch leaves neighbouring shards empty, for it cannot be cut.
An empty table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionloom.llm.common import text_or_empty
from actionloom.llm.prefix import prefix_sums

SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16
LAW = "bytes"


def record_size(text_col: str = "text") -> Column:
    return (F.octet_length(text_or_empty(text_col)) + OVERHEAD).cast("long")


def checksum(text_col: str = "text") -> Column:
    return F.crc32(text_or_empty(text_col).cast("binary"))


def assign(rows: DataFrame, size_col: str, order: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` with int ``shard`` and long ``slot``, the place in the shard, gapless from 0.

    The sizes together, times twice the number of shards, must stay below 2**63.
    """
    placed, _, total = prefix_sums(rows, order, size_col)
    middle = F.col("_before") * 2 + F.coalesce(F.col(size_col), F.lit(0))
    # Integer arithmetic throughout: a double could put a boundary document into either shard.
    target = F.call_function("div", middle * shards, F.lit(max(1, 2 * total)))
    dealt = placed.withColumn("shard", F.least(target, F.lit(shards - 1)).cast("int"))
    firsts = dealt.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most ``shards`` rows
    return dealt.join(F.broadcast(firsts), "shard").select(
        *[F.col(f"`{c}`") for c in rows.columns], "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    carry: Sequence[str] = ()) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot) of every document, and the columns of ``carry``."""
    narrow = docs.select(F.col(id_col), record_size(text_col).alias("size"), checksum(text_col).alias("text_crc32"),
                         *[F.col(c) for c in carry])
    return assign(narrow, "size", (id_col, "text_crc32", "size"), shards).withColumn("law", F.lit(LAW))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write the texts below ``path``, one folder ``shard=N`` each, and return the manifest.

    A partition holds a stretch of the order, so it writes into the few shards it crosses
    and nothing is exchanged for the writing. ``slot`` is stored with the texts. The manifest
    has one row per shard: shard, documents, bytes.
    """
    placed = shard_documents(docs, shards, id_col, text_col, carry=(text_col,))
    placed.select(id_col, text_col, "size", "text_crc32", "slot", "shard").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("bytes"))
