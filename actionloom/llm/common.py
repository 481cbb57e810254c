"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of one Arrow batch that are worked on together; bounds a task's memory.
SLICE_ROWS = 256
#: Bytes of such a piece, unless one row has more.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def slices(batch, rows: int = SLICE_ROWS, most_bytes: int | None = SLICE_BYTES):
    """An Arrow batch in pieces of a few rows and, but for single rows, a few megabytes."""
    for start in range(0, batch.num_rows, rows):
        waiting = [batch.slice(start, rows)]
        while waiting:
            part = waiting.pop()
            if most_bytes and part.num_rows > 1 and part.nbytes > most_bytes:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
