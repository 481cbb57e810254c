"""Language-model scores by deleted interpolation of n-gram estimates.

The maximum-likelihood estimates of all orders and a uniform share are mixed. The weights
depend on how often the context was seen, in buckets of powers of two, and are learned by
expectation-maximisation. The held-out counts are the deleted ones: each training token is
held out in turn, which takes one from its own counts and from those of its context.

Counting and looking up are two exchanges. Documents are read in blocks of bounded size. A
block sends each of its distinct n-grams once, as 64-bit hashes, to the bucket of the
hash; so a frequent n-gram costs a bucket one entry per block and no key is hot. Buckets
add up the counts and answer each block in the order it asked. A block keeps the counts of
its own n-grams only, so no vocabulary is gathered anywhere. Entries travel as sorted
differences in byte planes, which compress well.

Defined results: a null or empty text is the end token alone. Rows with a null held-out
flag are learned from. Without training rows every probability is uniform. Repeated rows
count as often as they occur. An empty table gives an empty result. Columns that are not
named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionloom.llm.common import SLICE_ROWS, SPACES, text_or_empty
from actionloom.llm.hashing import hash_pairs, hash_runs
from actionloom.session import discard, stored

ORDER = 2
#: Bytes of text in a block, unless one document has more.
BLOCK_BYTES = 3 << 20
#: Bytes of text for each bucket of n-grams, so that a bucket stays as large however much there is.
BUCKET_BYTES = 16 << 20
#: Steps per factor of two when probabilities are binned for the weights.
BINS_PER_OCTAVE = 8
#: More than any count can need: 2**12 steps are 512 octaves.
MOST_BINS = 1 << 12
ROUNDS = 200
_END, _START = np.uint64(1), np.uint64(2)
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, all lowest bytes, then all second bytes, as far as the largest needs."""
    numbers = numbers.astype("<u8")
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, :data[0]] = planes.T
    return numbers.view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


@dataclass
class Block:
    """Documents of one block: ids, whether they train, tokens per document, token keys."""

    ids: pa.Array
    train: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray

    def name(self) -> int:
        """A hash of the content, so that both passes call a block the same."""
        parts = np.array([len(self.keys), len(self.lengths)], np.uint64)
        numbers = np.concatenate((parts, self.keys, self.lengths.astype(np.uint64), self.train.astype(np.uint64)))
        named = np.frombuffer(np.array([str(self.ids.to_pylist())]).astype("U").tobytes(), np.uint32)
        both = hash_runs(np.concatenate((numbers, named.astype(np.uint64))), np.array([len(numbers) + len(named)]))
        return int(both.view(np.int64)[0])


def token_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all words and ends, tokens per text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    stream = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    word = ~_SPACE[stream]
    edges = np.diff(word.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    words = hash_runs(_LOWER[stream[word]], last - first)
    words[words <= _START] += np.uint64(3)  # the two marks have keys of their own
    ends = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw]))
    return np.insert(words, ends, _END), np.diff(ends, prepend=0) + 1


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """Blocks of the rows (id, held out, text), in order."""
    parts: list[tuple] = []
    size = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, SLICE_ROWS)
            start += part.num_rows
            keys, lengths = token_keys(part.column(2).to_pylist())
            parts.append((part.column(0), ~part.column(1).to_numpy(zero_copy_only=False), lengths, keys))
            size += part.column(2).nbytes
            if size >= limit:
                yield _block(parts)
                parts, size = [], 0
    if parts:
        yield _block(parts)


def _block(parts: list[tuple]) -> Block:
    ids, train, lengths, keys = zip(*parts)
    return Block(pa.concat_arrays(ids), np.concatenate(train), np.concatenate(lengths), np.concatenate(keys))


def grams(block: Block, order: int) -> Iterator[np.ndarray]:
    """For each n up to ``order``, the key of the n-gram that ends at each token."""
    starts = np.cumsum(block.lengths) - block.lengths
    found = block.keys
    yield found
    for n in range(2, order + 1):
        before = np.empty_like(found)
        before[1:] = found[:-1]
        before[starts] = _START
        found = hash_pairs(before + np.uint64(n), block.keys)
        yield found


def _cuts(keys: np.ndarray, bits: int) -> list[int]:
    """Where the buckets of sorted keys start, and their end."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]


def _requests(docs: DataFrame, order: int, bits: int, limit: int) -> DataFrame:
    """(n, bucket, block, keys, counts): what a block asks a bucket, with its training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit):
            name, trains = block.name(), np.repeat(block.train, block.lengths)
            for n, keys in enumerate(grams(block, order), 1):
                distinct, _ = np.unique(keys, return_counts=True)
                learned, times = np.unique(keys[trains], return_counts=True)
                counts = np.zeros(len(distinct), np.uint64)
                counts[np.searchsorted(distinct, learned)] = times
                cuts = _cuts(distinct, bits)
                spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(spans), pa.int32()), pa.array([b for b, _, _ in spans], pa.int32()),
                     pa.array([name] * len(spans), pa.int64()),
                     pa.array([pack_sorted(distinct[lo:hi]) for _, lo, hi in spans], pa.binary()),
                     pa.array([pack(counts[lo:hi]) for _, lo, hi in spans], pa.binary())],
                    names=["n", "bucket", "block", "keys", "counts"])

    return docs.mapInArrow(run, "n int, bucket int, block long, keys binary, counts binary")


_REPLY = "n int, bucket int, block long, counts binary, known long, total long"


def _answer(group: pa.Table) -> pa.Table:
    """The counts of one bucket to every block that asked, and a row of sums without a block."""
    names = ["n", "bucket", "block", "counts", "known", "total"]
    keys = [unpack_sorted(x.as_py()) for x in group.column("keys")]
    counts = np.concatenate([unpack(x.as_py()) for x in group.column("counts")])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), np.uint64)
    np.add.at(sums, at, counts)
    cuts = np.cumsum([0, *map(len, keys)])
    replies = [pack(sums[at[lo:hi]]) for lo, hi in zip(cuts, cuts[1:])]
    rows, n, bucket = len(replies), group.column("n")[0].as_py(), group.column("bucket")[0].as_py()
    return pa.Table.from_arrays(
        [pa.array([n] * (rows + 1), pa.int32()), pa.array([bucket] * (rows + 1), pa.int32()),
         pa.array([*group.column("block").to_pylist(), None], pa.int64()), pa.array([*replies, None], pa.binary()),
         pa.array([None] * rows + [int((sums > 0).sum())], pa.int64()),
         pa.array([None] * rows + [int(sums.sum())], pa.int64())], names=names)


def _streams(docs: DataFrame, kind: str, limit: int) -> DataFrame:
    """(block, ids, lengths, train, words, stream): the documents of a block, to meet its answers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit):
            words, stream = np.unique(block.keys, return_inverse=True)
            ids = pa.ListArray.from_arrays(pa.array([0, len(block.ids)], pa.int32()), block.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.name()], pa.int64()), ids, pa.array([pack(block.lengths)], pa.binary()),
                 pa.array([pack(block.train)], pa.binary()), pa.array([pack_sorted(words)], pa.binary()),
                 pa.array([pack(stream)], pa.binary())],
                names=["block", "ids", "lengths", "train", "words", "stream"])

    return docs.mapInArrow(
        run, f"block long, ids array<{kind}>, lengths binary, train binary, words binary, stream binary")


def _annotate(order: int):
    """Per block, the training count of the n-gram that ends at each token, for each n."""
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(order)]
        for row in range(block.num_rows):  # equal blocks share a name
            words = unpack_sorted(block.column("words")[row].as_py())
            stream = words[unpack(block.column("stream")[row].as_py()).astype(np.int64)]
            lengths = unpack(block.column("lengths")[row].as_py()).astype(np.int64)
            own = Block(None, None, lengths, stream)
            for n, keys in enumerate(grams(own, order), 1):
                sent = {b: c for m, b, c in zip(replies.column("n").to_pylist(), replies.column("bucket").to_pylist(),
                                                replies.column("counts")) if m == n}
                distinct, at = np.unique(keys, return_inverse=True)
                counts = np.concatenate([unpack(sent[b].as_py()) for b in sorted(sent)] or [np.empty(0, np.uint64)])
                if len(counts) != len(distinct):
                    raise RuntimeError("a block differs between the passes: store the documents first")
                columns[n - 1].append(pack(counts[at]))
        return pa.Table.from_arrays(
            [block.column(c).combine_chunks() for c in ("ids", "lengths", "train")] +
            [pa.array(c, pa.binary()) for c in columns],
            names=["ids", "lengths", "train", *[f"c{n}" for n in range(1, order + 1)]])

    return run


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct training tokens, training documents."""

    tokens: int
    distinct: int
    documents: int


def annotated(docs: DataFrame, held_col: str, id_col: str, text_col: str, order: int,
              block_bytes: int) -> tuple[DataFrame, Totals]:
    """A stored table of blocks with n-gram counts at every token, and the totals."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.col(held_col), F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), text_or_empty(text_col).alias("_text"))
    size, documents = rows.agg(F.sum(F.octet_length("_text")), F.count_if(~F.col("_held"))).first()
    bits = max(1, math.ceil(math.log2(max(2, (size or 0) / BUCKET_BYTES))))
    replies = stored(_requests(rows, order, bits, block_bytes).groupBy("n", "bucket").applyInArrow(_answer, _REPLY))
    sums = replies.filter("block IS NULL AND n = 1").agg(F.sum("total"), F.sum("known")).first()
    counts = ", ".join(f"c{n} binary" for n in range(1, order + 1))
    asked = replies.filter("block IS NOT NULL").select("block", "n", "bucket", "counts")
    table = stored(_streams(rows, kind, block_bytes).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        _annotate(order), f"ids array<{kind}>, lengths binary, train binary, {counts}"))
    discard(replies)
    return table, Totals(sums[0] or 0, sums[1] or 0, documents)


def _tokens(batch: pa.RecordBatch, row: int, order: int, totals: Totals):
    """(lengths, train flag per document, counts per n, context counts per n) of a block."""
    lengths, train = (unpack(batch.column(i)[row].as_py()).astype(np.int64) for i in (1, 2))
    counts = [unpack(batch.column(2 + n)[row].as_py()).astype(np.float64) for n in range(1, order + 1)]
    starts = np.cumsum(lengths) - lengths
    contexts = [np.full(len(counts[0]), float(totals.tokens))]
    for c in counts[:-1]:
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[starts] = totals.documents
        contexts.append(before)
    return lengths, train, counts, contexts


def _bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, else one more than its binary exponent."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _bins(q: np.ndarray) -> np.ndarray:
    steps = np.round(np.log2(np.maximum(q, 1e-300)) * BINS_PER_OCTAVE)
    return np.where(q > 0, np.minimum(1 - steps, MOST_BINS - 1), 0).astype(np.int64)


def _center(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, np.exp2((1 - bins) / BINS_PER_OCTAVE), 0.0)


def held_out_counts(table: DataFrame, order: int, totals: Totals) -> list[tuple]:
    """(bucket, bins of the deleted estimates, tokens), at most one row per bucket and bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, train, counts, contexts = _tokens(batch, row, order, totals)
                use = np.repeat(train > 0, lengths)
                rest = [c[use] - 1 for c in contexts]
                q = [np.where(r > 0, (c[use] - 1) / np.maximum(r, 1), 0.0) for c, r in zip(counts, rest)]
                code = _bucket_of(rest[-1])
                for b in map(_bins, q):
                    code = code * MOST_BINS + b
                cells, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n, pa.int64())], names=["cell", "n"])

    table = table.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = []
    for code, n in table.collect():
        bins = []
        for _ in range(order):
            code, b = divmod(code, MOST_BINS)
            bins.insert(0, b)
        found.append((code, *bins, n))
    return sorted(found)


def learn_weights(cells: list[tuple], order: int, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Rows of weights by context bucket: uniform share, then orders 1, 2 and so on."""
    weights = np.zeros((66, order + 1))
    if not cells:
        weights[:, 0] = 1.0
        return weights
    data = np.array(cells, np.int64)
    q = np.column_stack([np.full(len(data), uniform), *[_center(data[:, k]) for k in range(1, order + 1)]])

    def expect(rows: np.ndarray) -> np.ndarray:
        n, own = data[rows, -1].astype(float), q[rows]
        w = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(rounds):
            share = own * w
            w = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        return w

    weights[:] = expect(np.arange(len(data)))
    for bucket in np.unique(data[:, 0]):
        weights[bucket] = expect(np.flatnonzero(data[:, 0] == bucket))
    if order > 1:  # an unseen context has no estimate of the highest order
        weights[0, -1] = 0.0
        weights[0] /= weights[0].sum()
    return weights


def score(docs: DataFrame, held_col: str = "held_out", id_col: str = "doc_id", text_col: str = "text",
          order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``docs`` is read twice and has to give the same rows in the same order; files do.
    """
    table, totals = annotated(docs, held_col, id_col, text_col, order, block_bytes)
    uniform = 1.0 / (totals.distinct + 1)
    weights = learn_weights(held_out_counts(table, order, totals), order, uniform)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, held_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, train, counts, contexts = _tokens(batch, row, order, totals)
                w = weights[_bucket_of(contexts[-1])]
                p = w[:, 0] * uniform
                for n, (c, context) in enumerate(zip(counts, contexts), 1):
                    p += w[:, n] * np.where(context > 0, c / np.maximum(context, 1), 0.0)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((counts[0] + 1) / (totals.tokens + totals.distinct + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, pa.array(train == 0), pa.array(lengths, pa.int64()),
                     pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts), pa.int64()),
                     pa.array(np.full(len(lengths), totals.tokens), pa.int64()),
                     pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts))],
                    names=names)

    return table.mapInArrow(
        run, f"`{id_col}` {kind}, `{held_col}` boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
