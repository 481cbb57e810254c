"""Near duplicates by 64-bit fingerprints, with candidates pruned by pigeonring chains.

A fingerprint is cut into a ring of ``max_bits + 1`` segments. If two fingerprints differ
in at most ``max_bits`` bits, there is a segment from which every chain of l consecutive
segments differs in at most l * max_bits / segments bits. So the first segment of such a
chain is equal and the second differs in one bit at most. A fingerprint is therefore
*indexed* under each (segment, next segment), and *probes* each segment with the next one
as it is and with each of its bits turned. The join on these keys meets every pair that
keeps the first two budgets; the longer chains are tested before the full distance.

No group of near copies is expanded into all pairs. Fingerprints are distinct values with
a document count. Under each key everybody is first tied to the most frequent fingerprint
there, where close enough, which costs one row per probe. Only keys that still hold
fingerprints of different components are joined pair by pair, and only for pairs across
components, until the links between classes are complete.

Defined results: null and empty texts have fingerprint zero, which links like any other.
Rows with a null id are classified and are never a class id unless all ids are null. An
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionloom.llm.common import slices, text_or_empty, unused_name
from actionloom.llm.components import connected_components
from actionloom.session import discard, stored

SHINGLE_WORDS = 4
MAX_BITS = 4
BITS = 64
SEED = 42
#: Shingles hashed and counted together; bounds memory for very long texts.
BLOCK_SHINGLES = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _bit_counts(joined: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), BLOCK_SHINGLES):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[i:i + BLOCK_SHINGLES], ends[i:i + BLOCK_SHINGLES])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of all shingle hashes, as a signed 64-bit integer."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    counts = _bit_counts(joined, starts[:n].tolist(), ends[-n:].tolist())
    packed = np.packbits(counts * 2 > n, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = [fingerprint(t.as_py(), shingle_words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def ring(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments."""
    m = max_bits + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _segment(fp: str, offset: int, width: int) -> str:
    return f"(shiftrightunsigned({fp}, {offset}) & {(1 << width) - 1}L)"


def _keys(max_bits: int, probing: bool) -> Column:
    """The keys of ``fp``: start segment, its value and the next segment's value in one long."""
    segments, keys = ring(max_bits), []
    for i, (offset, width) in enumerate(segments):
        next_offset, next_width = segments[(i + 1) % len(segments)]
        base = f"(shiftleft({i}L, 58) | shiftleft({_segment('fp', offset, width)}, 29) | " \
               f"{_segment('fp', next_offset, next_width)})"
        # The second chain budget, floor(2 * max_bits / segments), is one bit for any max_bits.
        keys += [base] + [f"({base} ^ {1 << b}L)" for b in range(next_width if probing and max_bits else 0)]
    return F.explode(F.array(*[F.expr(k) for k in keys]))


def _within_budget(left: str, right: str, max_bits: int) -> Column:
    """Whether some chain start keeps every chain budget, and the whole distance fits."""
    segments = ring(max_bits)
    m = len(segments)
    x = f"({left} ^ {right})"
    chains = []
    for i in range(m):
        spent, steps = [], []
        for length in range(1, m + 1):
            offset, width = segments[(i + length - 1) % m]
            spent.append(f"bit_count({_segment(x, offset, width)})")
            steps.append(f"{' + '.join(spent)} <= {length * max_bits // m}")
        chains.append("(" + " AND ".join(steps) + ")")
    return F.expr(f"({' OR '.join(chains)}) AND bit_count({x}) <= {max_bits}")


def links(counted: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints in ``counted`` (fp, n) that are close enough.

    Not every such pair, but enough of them for the same connected components.
    """
    if max_bits == 0:  # different fingerprints are never that close
        return counted.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter(F.lit(False))
    index = counted.select(_keys(max_bits, probing=False).alias("key"), "fp", "n")
    leaders = index.groupBy("key").agg(
        F.max_by("fp", F.struct("n", "fp")).alias("leader"), F.count(F.lit(1)).alias("members"))
    probes = counted.select(_keys(max_bits, probing=True).alias("key"), "fp")
    close = _within_budget("fp", "leader", max_bits) & (F.col("fp") != F.col("leader"))
    # Sizes before the explode say nothing about sizes after it, so none of these is broadcast.
    met = stored(probes.hint("merge").join(leaders, "key").select("key", "fp", "leader", "members", close.alias("close"))
                 .filter("close OR members > 1"))
    ties = stored(met.filter("close").select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct())
    classes = stored(connected_components(ties, "a", "b"))

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(classes, rows["fp"] == classes["node"], "left").select(
            "key", "fp", F.coalesce("component", "fp").alias("class"))

    # Under keys with several members, the leader has been compared with everyone.
    probing = stored(classed(met.filter("members > 1").select("key", "fp")))
    crowded = met.filter("members > 1").select("key").distinct()
    indexed = stored(classed(index.join(crowded.hint("merge"), "key", "left_semi").join(
        leaders.select("key", F.col("leader").alias("fp")).hint("merge"), ["key", "fp"], "left_anti").select("key", "fp")))
    mixed = probing.select("key", "class").union(indexed.select("key", "class")).groupBy("key").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key")
    one = probing.join(mixed, "key", "left_semi").select("key", F.col("fp").alias("a"), F.col("class").alias("ca"))
    two = indexed.join(mixed, "key", "left_semi").select("key", F.col("fp").alias("b"), F.col("class").alias("cb"))
    across = one.join(two, (one["key"] == two["key"]) & (F.col("ca") != F.col("cb"))
                      & _within_budget("a", "b", max_bits)).select("a", "b")
    found = stored(ties.union(across).distinct())
    discard(met, ties, classes, probing, indexed)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links."""
    hashed = stored(fingerprints(docs, id_col, text_col, shingle_words))
    counted = stored(hashed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("_least")))
    classes = connected_components(links(counted, max_bits), "a", "b")
    classed = counted.join(classes, counted["fp"] == classes["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("_class"), "_least")
    names = classed.groupBy("_class").agg(F.min("_least").alias("component_id"))
    named = stored(classed.join(names, "_class").select(F.col("fp").alias("_fp"), "component_id"))
    return hashed.join(named, hashed["fp"] == named["_fp"]).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component.

    Rows that repeat the kept id stay; a class without any id stays as a whole.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone_id = unused_name(docs, "_llm_id")
    gone = stored(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone_id)))
    nameless = F.col(id_col).isNull()
    kept = docs.filter(~nameless).join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    return kept.unionByName(docs.filter(nameless))


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
