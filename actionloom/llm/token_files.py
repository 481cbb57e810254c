"""Flat token files without an index: writing them, and finding documents by their end ids.

A file is a run of fixed-width ids; every document is followed by the end id and nothing
else says where documents are. The scan reads blocks of a file wherever they lie and
searches each at once for end ids. A block knows only its own ends, so a prefix scan
over block summaries (ends so far, position of the last end) gives each block the number
of its first document and where that began. The scan has two levels, blocks of a segment
and segments of a file, so the blocks of one huge file are not gathered in one window.

Files are reached by pyarrow's file systems, so the folder may be a mounted path or any
store these know. A task writes under a name of its own and moves the file when it is
whole; files of failed attempts are not in the manifest and are not read.

Defined results: null and empty texts are documents of zero tokens. Special tokens spelled
out in a text are ordinary text, so the end id never occurs inside a document. Ids after
the last end are a document that is not ended. An empty folder or table gives an empty
result. Repeated rows are repeated documents. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actionloom.llm.byte_bpe import encoder
from actionloom.llm.common import slices, text_or_empty
from actionloom.session import stored

WIDTH = 2
BLOCK_TOKENS = 1 << 20
SEGMENT_BLOCKS = 1024


def file_system(folder: str):
    """(file system, path) of a folder given as a path or an address."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` to flat files in ``folder``, one file per task.

    Returns the stored manifest (id, file, nth): the nth document of a file. End ids follow
    every document; ids take ``WIDTH`` bytes, little-endian.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        if max(end_id, *bpe.special.values(), bpe.largest) >> (8 * WIDTH):
            raise ValueError("an id does not fit the width of the files")
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin"
        end, nth = end_id.to_bytes(4, "little"), 0
        with store.open_output_stream(f"{root}/_{name}") as out:
            for batch in batches:
                for part in slices(batch):
                    ids = b"".join(bpe.encode_plain(t) + end for t in part.column(1).to_pylist())
                    out.write(np.frombuffer(ids, "<u4").astype(f"<u{WIDTH}").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([name] * part.num_rows), pa.array(range(nth, nth + part.num_rows), pa.int64())],
                        names=[id_col, "file", "nth"])
                    nth += part.num_rows
        store.move(f"{root}/_{name}", f"{root}/{name}")

    store, root = file_system(folder)
    store.create_dir(root, recursive=True)  # there even if no task writes
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_or_empty(text_col).alias("_text"))
    return stored(rows.mapInArrow(run, f"`{id_col}` {kind}, file string, nth long"))


def _blocks(files: DataFrame, folder: str, end_id: int, width: int, block_tokens: int) -> DataFrame:
    """(file, block, ends, tokens): positions of end ids in the file, found block by block."""
    size = width * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{file}") as source:
                    data = source.read_at(size, block * size)
                ids = np.frombuffer(data, f"<u{width}", count=len(data) // width)
                ends = np.flatnonzero(ids == end_id) + block * block_tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int64())),
                     pa.array([len(ids)], pa.int64())], names=["file", "block", "ends", "tokens"])

    last = F.greatest(F.lit(0), F.ceil(F.col("bytes") / size) - 1)
    plan = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    return plan.repartition("file", "block").mapInArrow(run, "file string, block long, ends array<long>, tokens long")


def scan_token_files(files: DataFrame, folder: str, end_id: int, width: int = WIDTH,
                     block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, nth, start, n_tokens, ended) of every document in ``files`` (file, bytes)."""
    found = stored(_blocks(files, folder, end_id, width, block_tokens))
    totals = found.select(
        "file", "block", F.floor(F.col("block") / SEGMENT_BLOCKS).alias("segment"),
        F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last"))
    segments = totals.groupBy("file", "segment").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = W.partitionBy("file").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    carried = segments.select("file", "segment", F.sum("n").over(before).alias("seg_n"),
                              F.max("last").over(before).alias("seg_last"))
    inside = W.partitionBy("file", "segment").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    prefix = totals.select("file", "block", "segment", F.sum("n").over(inside).alias("own_n"),
                           F.max("last").over(inside).alias("own_last")).join(carried, ["file", "segment"]).select(
        "file", "block",
        (F.coalesce("own_n", F.lit(0)) + F.coalesce("seg_n", F.lit(0))).alias("first"),
        (F.coalesce("own_last", "seg_last", F.lit(-1)) + 1).alias("begun"))
    known = found.join(prefix, ["file", "block"])
    ended = known.select("file", "first", "begun", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("first") + F.col("i")).alias("nth"),
        F.when(F.col("i") == 0, F.col("begun")).otherwise(F.element_at("ends", F.greatest("i", F.lit(1))) + 1).alias("start"),
        "end").select("file", "nth", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = known.groupBy("file").agg(
        F.max(F.col("block") * block_tokens + F.col("tokens")).alias("total"),
        F.max(F.col("first") + F.size("ends")).alias("nth"),
        F.max(F.coalesce(F.array_max("ends") + 1, "begun")).alias("start"))
    rest = tails.filter(F.col("total") > F.col("start")).select(
        "file", "nth", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def listed(spark, folder: str) -> DataFrame:
    """(file, bytes) of the token files in ``folder``; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
