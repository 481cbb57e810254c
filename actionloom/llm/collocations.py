"""Phrase collocations by direct-address tiling of ranked pairs.

Words that are frequent enough are ranked by frequency, language by language, and texts become
rows of ranks. Neighbouring ranks (left, right) are cells of a plane cut into tiles whose sides
double from one to the next, so under the usual distribution of words the tiles hold about
equally much. Tiles of few cells that many pairs hit are counted densely, by ``bincount`` over
their cells; the others as sorted coordinates. The frequent pairs are ranked by frequency again,
and (rank of a pair, word) is the plane in which three words are counted; and so on up to the
longest phrase. An n-gram is looked at only where both its (n-1)-grams are frequent, which loses
nothing: no part of a frequent phrase is rarer than the phrase.

Texts are read in chunks of bounded size. What a chunk counted goes up a tree of bounded
fan-in to the tile's sum, and the ranks of the frequent cells come back down the same tree, each
node getting those cells only that it has asked for. So neither a vocabulary nor a hot tile is
ever held in one place. Single words travel as rows and are added up before the exchange.

Defined results: a null text is empty, a null language ``und``. Scores are floored quotients of
integers beyond 64 bits. Ties in score and count go to the lesser phrase in byte order. Repeated
rows count as often as they occur. An empty table gives an empty result. Columns that are not
named are ignored. Ranks must stay below 2**31 in each language, and a text is held whole by a
task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from actionloom.llm.common import SLICE_ROWS, text_or_empty
from actionloom.llm.hashing import mix
from actionloom.llm.interpolated_lm import pack, pack_sorted, unpack, unpack_sorted
from actionloom.llm.prefix import prefix_sums
from actionloom.session import discard, stored

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one that holds it is at least so frequent: per cent.
ABSORBED = 80
SCORE_SCALE = 2_000_000
UNKNOWN = "und"
#: Bytes of text in a chunk, unless one text has more.
CHUNK_BYTES = 8 << 20
#: Partial counts that are added up together.
FAN_IN = 32
#: Side of the first tile; the next begins where it ends and each further one is twice as wide.
FIRST_SIDE = 1024
#: The most cells of a tile that is counted densely: 32 MB of counts.
DENSE_CELLS = 1 << 22
#: Pairs in a language for each bucket that a sparse tile is split into.
BUCKET_PAIRS = 1 << 24
_STARTS = np.concatenate(([0], FIRST_SIDE << np.arange(22)))
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 between words, 2 between pieces
_KIND[[ord(c) for c in " \t"]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# Texts to chunks.

def encode(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, words, counts): 1 + the number of each word in order, 0 between pieces; the words
    by falling count."""
    stream = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kinds = _KIND[stream]
    word = kinds == 0
    edges = np.diff(word.view(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    piece = np.searchsorted(np.flatnonzero(kinds == 2), first)
    offsets = np.concatenate(([0], np.cumsum(last - first)))
    letters = _LOWER[stream[word]]
    found = pa.LargeStringArray.from_buffers(
        len(first), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    numbers = found.indices.to_numpy()
    counts = np.bincount(numbers, minlength=len(found.dictionary))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    codes = np.insert(place[numbers], np.flatnonzero(np.diff(piece)) + 1, 0)
    return codes, found.dictionary.take(pa.array(order)).cast(pa.string()), counts[order]


def _read(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, size = TaskContext.get().partitionId(), 0, 0
        held: dict[str, list[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                codes, words, counts = encode(texts)
                if not len(counts):
                    continue
                lists = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([(part << 32) + made], pa.int64()), pa.array([pack(codes)], pa.binary()),
                     lists(words), lists(pa.array(counts, pa.int64())), pa.array([int(counts.sum())], pa.int64())],
                    names=["lang", "chunk", "codes", "words", "counts", "total"])
                made += 1

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                    held.setdefault(lang, []).append(text.as_buffer().to_pybytes())
                    size += len(held[lang][-1])
                    if size >= limit:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return run


_CHUNK = "lang string, chunk long, codes binary, words array<string>, counts array<long>, total long"
_STATE = "lang string, chunk long, words binary, grams binary"


# A chunk's state: ranks + 1 of words and of the n-grams that begin there, 0 for none.

def _packed_state(group: pa.Table, words: np.ndarray, grams: np.ndarray, n: int) -> pa.Table:
    """The places that a frequent (n+1)-gram can cover; what lies between shrinks to one 0."""
    both = np.flatnonzero((grams[:-1] > 0) & (grams[1:] > 0))
    if not len(both):
        return pa.table({"lang": pa.array([], pa.string()), "chunk": pa.array([], pa.int64()),
                         "words": pa.array([], pa.binary()), "grams": pa.array([], pa.binary())})
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, both, 1)
    np.add.at(change, np.minimum(both + n + 1, len(words)), -1)
    covered = np.cumsum(change[:-1]) > 0
    keep = covered | np.concatenate(([False], covered[:-1]))  # one place after each stretch
    words, grams = np.where(covered, words, 0)[keep], np.where(covered, grams, 0)[keep]
    return pa.table({"lang": group.column("lang").slice(0, 1), "chunk": group.column("chunk").slice(0, 1),
                     "words": pa.array([pack(words)], pa.binary()), "grams": pa.array([pack(grams)], pa.binary())})


def _word_state(chunk: pa.Table, ranks: pa.Table) -> pa.Table:
    if not chunk.num_rows or not ranks.num_rows:
        return _packed_state(chunk, np.zeros(0, np.int64), np.zeros(0, np.int64), 1)
    codes = unpack(chunk.column("codes")[0].as_py()).astype(np.int64)
    rank = np.zeros(int(codes.max()) + 1, np.int64)
    rank[ranks.column("place").to_numpy() + 1] = ranks.column("id").to_numpy() + 1
    return _packed_state(chunk, rank[codes], rank[codes], 1)


def _pairs(words: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pairs): where n words may be frequent, and (left rank, right rank) as one number."""
    at = np.flatnonzero((grams[:-1] > 0) & (grams[1:] > 0))
    return at, (grams[at] - 1 << 32) | (words[at + n - 1] - 1)


def _gram_state(n: int):
    def run(state: pa.Table, replies: pa.Table) -> pa.Table:
        if not state.num_rows or not replies.num_rows:
            return _packed_state(state, np.zeros(0, np.int64), np.zeros(0, np.int64), n)
        words = unpack(state.column("words")[0].as_py()).astype(np.int64)
        grams = unpack(state.column("grams")[0].as_py()).astype(np.int64)
        at, pairs = _pairs(words, grams, n)
        known = np.concatenate([unpack_sorted(x.as_py()) for x in replies.column("pairs")]).astype(np.int64)
        ids = np.concatenate([unpack(x.as_py()) for x in replies.column("ids")]).astype(np.int64)
        order = np.argsort(known)
        known, ids = known[order], ids[order]
        near = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        fresh = np.zeros(len(words), np.int64)
        fresh[at] = np.where(known[near] == pairs, ids[near] + 1, 0)
        return _packed_state(state, words, fresh, n)

    return run


# Counting in tiles.

def _tile(pairs: np.ndarray) -> np.ndarray:
    left = np.searchsorted(_STARTS, pairs >> 32, side="right") - 1
    right = np.searchsorted(_STARTS, pairs & 0xFFFFFFFF, side="right") - 1
    return left * len(_STARTS) + right


class Tile(NamedTuple):
    left: int
    right: int
    height: int
    width: int

    @property
    def dense(self) -> bool:
        return self.height * self.width <= DENSE_CELLS

    def cells(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs >> 32) - self.left) * self.width + ((pairs & 0xFFFFFFFF) - self.right)

    def pairs(self, cells: np.ndarray) -> np.ndarray:
        return (cells // self.width + self.left << 32) | (cells % self.width + self.right)


def tile_of(number: int) -> Tile:
    side = lambda i: int(_STARTS[i + 1] - _STARTS[i]) if i + 1 < len(_STARTS) else 1 << 31
    i, j = divmod(number, len(_STARTS))
    return Tile(int(_STARTS[i]), int(_STARTS[j]), side(i), side(j))


def count_tile(tile: Tile, pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs in order, counts) of the pairs of one tile."""
    if tile.dense and len(pairs) * 16 >= tile.height * tile.width:
        cells = tile.cells(pairs)
        if times is None:
            counts = np.bincount(cells, minlength=tile.height * tile.width)
        else:
            counts = np.zeros(tile.height * tile.width, np.int64)
            np.add.at(counts, cells, times)
        hit = np.flatnonzero(counts)
        return tile.pairs(hit), counts[hit]
    if times is None:
        return np.unique(pairs, return_counts=True)
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


_ASKED = "lang string, tile int, bucket int, node long, pairs binary, counts binary"


def _ask(n: int, buckets: dict[str, int]):
    """What a chunk counted, by tile; sparse tiles in buckets by a hash of the pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, pairs = _pairs(unpack(row["words"]).astype(np.int64), unpack(row["grams"]).astype(np.int64), n)
                tiles = _tile(pairs)
                order = np.argsort(tiles, kind="stable")
                pairs, tiles = pairs[order], tiles[order]
                cuts = [*np.flatnonzero(np.diff(tiles, prepend=-1)).tolist(), len(tiles)]
                rows = []
                for a, b in zip(cuts, cuts[1:]):
                    number = int(tiles[a])
                    tile = tile_of(number)
                    distinct, counts = count_tile(tile, pairs[a:b])
                    most = 1 if tile.dense else buckets.get(row["lang"], 1)
                    bucket = (mix(distinct.astype(np.uint64)) % np.uint64(most)).astype(np.int64)
                    for k in np.unique(bucket).tolist():
                        here = bucket == k
                        rows.append((number, k, pack_sorted(distinct[here].astype(np.uint64)), pack(counts[here])))
                if rows:
                    tile, bucket, keys, counts = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["lang"]] * len(rows)), pa.array(tile, pa.int32()), pa.array(bucket, pa.int32()),
                         pa.array([row["chunk"]] * len(rows), pa.int64()), pa.array(keys, pa.binary()),
                         pa.array(counts, pa.binary())], names=["lang", "tile", "bucket", "node", "pairs", "counts"])

    return run


def _head(group: pa.Table, rows: int = 1) -> list[pa.Array]:
    return [pa.array(group.column(c).slice(0, 1).to_pylist() * rows, group.schema.field(c).type)
            for c in ("lang", "tile", "bucket")]


def _add(group: pa.Table) -> pa.Table:
    """The sum of at most some dozens of partial counts of one bucket of a tile."""
    tile = tile_of(group.column("tile")[0].as_py())
    pairs = np.concatenate([unpack_sorted(x.as_py()) for x in group.column("pairs")]).astype(np.int64)
    counts = np.concatenate([unpack(x.as_py()) for x in group.column("counts")]).astype(np.int64)
    pairs, counts = count_tile(tile, pairs, counts)
    return pa.Table.from_arrays(
        [*_head(group), group.column("parent").slice(0, 1).combine_chunks(),
         pa.array([pack_sorted(pairs.astype(np.uint64))], pa.binary()), pa.array([pack(counts)], pa.binary())],
        names=["lang", "tile", "bucket", "node", "pairs", "counts"])


def _frequent(least: int):
    """The pairs of the summed buckets that are frequent, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, counts = unpack_sorted(row["pairs"]).astype(np.int64), unpack(row["counts"]).astype(np.int64)
                pairs, counts = pairs[counts >= least], counts[counts >= least]
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["lang"]] * n, pa.string()), pa.array([row["tile"]] * n, pa.int32()),
                     pa.array([row["bucket"]] * n, pa.int32()), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF),
                     pa.array(counts)], names=["lang", "tile", "bucket", "left", "right", "f"])

    return run


_REPLY = "lang string, tile int, bucket int, node long, pairs binary, ids binary"


def _pack_ids(group: pa.Table) -> pa.Table:
    pairs = (group.column("left").to_numpy() << 32) | group.column("right").to_numpy()
    order = np.argsort(pairs)
    return pa.Table.from_arrays(
        [*_head(group), pa.array([0], pa.int64()), pa.array([pack_sorted(pairs[order].astype(np.uint64))], pa.binary()),
         pa.array([pack(group.column("id").to_numpy()[order])], pa.binary())],
        names=["lang", "tile", "bucket", "node", "pairs", "ids"])


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """To each child of a node the ids of the pairs that it asked for."""
    rows = []
    if asked.num_rows and known.num_rows:
        pairs, ids = unpack_sorted(known.column("pairs")[0].as_py()), unpack(known.column("ids")[0].as_py())
        for node, asks in zip(asked.column("node").to_pylist(), asked.column("pairs")):
            wanted = unpack_sorted(asks.as_py())
            at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            hit = pairs[at] == wanted
            if hit.any():
                rows.append((node, pack_sorted(wanted[hit]), pack(ids[at[hit]])))
    node, keys, ids = zip(*rows) if rows else ((), (), ())
    head = _head(known, len(rows)) if rows else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32())]
    return pa.Table.from_arrays(
        [*head, pa.array(node, pa.int64()), pa.array(keys, pa.binary()), pa.array(ids, pa.binary())],
        names=["lang", "tile", "bucket", "node", "pairs", "ids"])


def ranked(rows: DataFrame, *ties: str) -> DataFrame:
    """``rows``, stored, with long ``id``: from 0 in each language, by falling ``f``, then ``ties``."""
    least = rows.withColumn("_least", -F.col("f"))
    placed = prefix_sums(least, ["lang", "_least", *ties]).rows
    firsts = placed.groupBy("lang").agg(F.min("_row").alias("_first"))
    found = stored(placed.join(firsts, "lang").withColumn("id", F.col("_row") - F.col("_first")).drop(
        "_row", "_before", "_first", "_least"))
    discard(placed)
    return found


def _count_level(state: DataFrame, n: int, least: int, buckets: dict[str, int], chunks: int,
                 fan_in: int) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Frequent pairs of ``state``, ranked, and the tables of the tree, leaves first."""
    levels = []
    current = stored(state.mapInArrow(_ask(n, buckets), _ASKED))
    nodes = chunks
    while True:
        # Chunks are numbered with gaps, so the first step deals them out by a hash.
        parents = max(1, -(-nodes // fan_in))
        levels.append((current, parents))
        name = F.xxhash64("node") if len(levels) == 1 else F.col("node")
        current = stored(current.withColumn("parent", F.pmod(name, F.lit(parents)))
                         .groupBy("lang", "tile", "bucket", "parent").applyInArrow(_add, _ASKED))
        nodes = parents
        if nodes == 1:
            break
    frequent = current.mapInArrow(
        _frequent(least), "lang string, tile int, bucket int, left long, right long, f long")
    return ranked(frequent, "left", "right"), [*levels, (current, 1)]


def _replies(found: DataFrame, levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """The ids of frequent pairs, down the tree to the chunks that hold them."""
    key = ["lang", "tile", "bucket"]
    known = found.groupBy(*key).applyInArrow(_pack_ids, _REPLY)
    for depth, (asked, parents) in reversed(list(enumerate(levels[:-1]))):  # the last are the sums themselves
        name = F.xxhash64("node") if depth == 0 else F.col("node")
        children = asked.select(*key, F.pmod(name, F.lit(parents)).alias("parent"), "node", "pairs")
        known = children.groupBy(*key, "parent").cogroup(
            known.withColumnRenamed("node", "parent").groupBy(*key, "parent")).applyInArrow(_answer, _REPLY)
    return known.withColumnRenamed("node", "chunk")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT,
                     longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES,
                     fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, totals), the first two stored.

    phrases: lang, w (ids of its words), f, for all phrases of one to ``longest`` words that
    occur ``least`` times or more. vocabulary: lang, word, f, id. totals: lang, n.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        text_or_empty(text_col).alias("text"))
    chunks = stored(texts.mapInArrow(_read(chunk_bytes), _CHUNK))
    words = chunks.select("lang", "chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(
        "lang", "chunk", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = chunks.groupBy("lang").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("chunks"))
    known = totals.collect()  # one row per language
    buckets = {r["lang"]: -(-r["n"] // BUCKET_PAIRS) for r in known}
    vocabulary = ranked(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "word")
    # Columns of their own, since both sides of the cogroup come from the same table.
    coded = chunks.select(F.col("lang").alias("lang"), F.col("chunk").alias("chunk"), "codes")
    state = stored(coded.groupBy("lang", "chunk").cogroup(
        words.join(vocabulary, ["lang", "word"]).select("lang", "chunk", "place", "id").groupBy("lang", "chunk"),
    ).applyInArrow(_word_state, _STATE))
    spell = vocabulary.select("lang", "id", F.array("id").alias("w"), "f")
    phrases = [spell]
    for n in range(2, longest + 1):
        found, levels = _count_level(state, n, least, buckets, sum(r["chunks"] for r in known), fan_in)
        spell = found.select("lang", F.col("left").alias("_left"), "right", "f", "id").join(
            spell.select("lang", F.col("id").alias("_left"), "w"), ["lang", "_left"]).select(
            "lang", "id", F.concat("w", F.array("right")).alias("w"), "f")
        phrases.append(spell)
        spent = state
        if n < longest:
            state = stored(state.groupBy("lang", "chunk").cogroup(
                _replies(found, levels).groupBy("lang", "chunk")).applyInArrow(_gram_state(n), _STATE))
        discard(spent, *[t for t, _ in levels])
    every = phrases[0].select("lang", "w", "f")
    for more in phrases[1:]:
        every = every.unionByName(more.select("lang", "w", "f"))
    every = stored(every)
    totals = stored(totals.select("lang", "n"))
    discard(chunks)
    return every, vocabulary, totals


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT,
         longest: int = LONGEST, top: int = TOP, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase is scored at its weakest cut: twice its count over the counts of the two parts,
    scaled and floored. Phrases that mostly occur inside a longer one are left out.
    """
    phrases, vocabulary, totals = frequent_phrases(docs, lang_col, text_col, least, longest, chunk_bytes, fan_in)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = phrases.filter(F.size("w") > 1).withColumnRenamed("f", "a")
    size = F.size("w")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("wl"),
        F.slice("w", F.col("k") + 1, size - F.col("k")).alias("wr"))
    part = lambda words, count: phrases.select("lang", F.col("w").alias(words), F.col("f").alias(count))
    score = F.call_function("div", F.lit(SCORE_SCALE).cast("decimal(10,0)") * exact("a"), exact("l") + exact("r"))
    weakest = (
        cuts.join(part("wl", "l"), ["lang", "wl"]).join(part("wr", "r"), ["lang", "wr"])
        .groupBy("lang", "w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), "
                   "m -> transform(sequence(1, size(w) - m + 1), s -> slice(w, s, m))))")
    around = candidates.filter(size > 2).select("lang", "a", F.explode(inner).alias("w")).groupBy("lang", "w").agg(
        F.max("a").alias("longer"))
    gone = F.coalesce(exact("longer") * 100 >= exact("a") * ABSORBED, F.lit(False))
    scored = weakest.join(around, ["lang", "w"], "left").filter(~gone).select(
        "lang", "w", "a", "cut.l", "cut.r", "cut.score")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    leading = scored.withColumn("_place", F.rank().over(best)).filter(F.col("_place") <= top).drop("_place")
    spelled = leading.select("*", F.posexplode("w").alias("_at", "id")).join(
        vocabulary.select("lang", "id", "word"), ["lang", "id"]).groupBy("lang", "w", "a", "l", "r", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ")
        .alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(
        totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
