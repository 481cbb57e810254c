"""From raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of documents; the last returns one row per packed piece.

1. language ID: documents without a letter, or whose best language is less likely than
   ``LEAST_LANGUAGE_SCORE``, go.
2. toxicity: documents with a score of 0.5 or more go.
3. exact dedup: of texts that are equal but for white space, the longest stays.
4. SimHash near-dedup: of each group, the document with the smallest id stays.
5. best-fit packing: into sequences of 1024 tokens.

An empty table passes through every stage and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from actionloom.llm import exact_dedup, language, packing, simhash, toxicity
from actionloom.llm.common import held_out, read_table
from actionloom.llm.queries import vocabulary
from actionloom.session import discard, stored, tune

#: Below this, more than one language is as likely as the best.
LEAST_LANGUAGE_SCORE = 0.4
#: Learned from documents whose crc32 of the id leaves another remainder.
FOLDS, HELD_FOLD = 5, 0

#: The stages are learned models and packing, which SQL cannot express.
ORACLE_SQL = None


def _learning(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out("doc_id", FOLDS, HELD_FOLD))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(_learning(docs))
    return language.keep_identified(docs, model, LEAST_LANGUAGE_SCORE)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(_learning(docs), read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("toxicity", toxic_filter),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(tune(spark), sf_dir, "documents")
    previous = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if previous is not None:
            discard(previous)
        previous = docs
    return docs
