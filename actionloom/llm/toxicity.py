"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. A sentence is toxic with the probability a logistic
model of its words gives, a document with the probability that one of its sentences is.
Only document labels are used for learning. The model is fitted by proximal gradient
steps on the bag likelihood, with an l1 penalty under which only words survive that help
across documents. The same model then says which sentences are at fault.

The fit uses a sample of at most ``sample_per_class`` documents per label, a documented
bound; scoring covers whole texts.

Defined results: a null or empty text has no sentence and score 0. Null labels and labels
of unknown documents are ignored; of several labels of a document, the largest counts.
Without both labels nothing is learned and the score is the share of toxic labels. Very
long texts are read in pieces that end after a line or sentence. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionloom.llm.codepoints import cut, points, tables
from actionloom.llm.common import slices, text_or_empty
from actionloom.llm.hashing import hash_runs

SAMPLE_PER_CLASS = 1000
THRESHOLD = 0.5
#: Characters after which a sentence ends.
SENTENCE_ENDS = ".!?\n"
#: Besides whole words, their first so many letters are features.
BEGINNINGS = (3, 4, 5, 6, 7)
_START_BIAS = -5.0


@dataclass(frozen=True)
class Settings:
    sample_per_class: int = SAMPLE_PER_CLASS
    iterations: int = 300
    rate: float = 0.5
    #: Words of fewer sampled documents are not used: they say more about a document than a label.
    least_documents: int = 3
    #: Weight of the l1 penalty, in toxic documents.
    l1_documents: float = 0.3
    seed: int = 42


@dataclass(frozen=True)
class Model:
    """words: ascending hashes with a weight that isn't zero; constant: the score of all texts."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None


@dataclass(frozen=True)
class Words:
    """The words of some texts: hash and sentence of each; text, start and end of each sentence."""

    hashes: np.ndarray
    sentences: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def read_words(texts: list[str | None]) -> Words:
    """Sentences count only if they hold a word; starts and ends are code points of the text."""
    _, word, lower = tables()
    found = [(i, offset, piece) for i, t in enumerate(texts) for offset, piece in cut(t or "")]
    stream = points("\n".join(p for _, _, p in found) + "\n")
    in_word = word[stream]
    edges = np.diff(in_word.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, none, none)
    letters, lengths = lower[stream], last - first
    # The whole word, and its beginnings, which compounds and inflected forms share.
    hashes, word_of = [hash_runs(letters[in_word], lengths)], [np.arange(len(first))]
    for n in BEGINNINGS:
        longer = np.flatnonzero(lengths > n)
        taken = letters[(first[longer][:, None] + np.arange(n)).reshape(-1)]
        hashes.append(hash_runs(taken, np.full(len(longer), n)) ^ np.uint64(n))
        word_of.append(longer)
    breaks = np.flatnonzero(np.isin(stream, np.array([ord(c) for c in SENTENCE_ENDS], np.uint32)))
    cell = np.searchsorted(breaks, first)  # the break that ends the word's sentence
    kept, sentences = np.unique(cell, return_inverse=True)
    sentences = sentences[np.concatenate(word_of)]
    starts = np.where(kept > 0, breaks[kept - 1] + 1, 0)
    marks = np.cumsum([0, *[len(p) + 1 for _, _, p in found]])
    piece = np.searchsorted(marks, starts, side="right") - 1
    shift = np.array([o for _, o, _ in found]) - marks[:-1]
    owner = np.array([i for i, _, _ in found])[piece]
    return Words(np.concatenate(hashes), sentences, owner, starts + shift[piece], breaks[kept] + shift[piece])


def _sentence_logits(words: Words, model: Model) -> np.ndarray:
    z = np.full(len(words.owner), model.bias)
    if len(model.words):
        at = np.minimum(np.searchsorted(model.words, words.hashes), len(model.words) - 1)
        hit = model.words[at] == words.hashes
        np.add.at(z, words.sentences[hit], model.weights[at[hit]])
    return z


def _all_clean(z: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the logarithm of the chance that none of its sentences is toxic."""
    return np.bincount(owner, weights=-np.logaddexp(0.0, z), minlength=texts)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
            settings: Settings) -> tuple[pa.Table, dict[int, int]]:
    """((label, hashes, sentences) of at most ``sample_per_class`` documents per label, all labels' totals)."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_llm_id")).agg(
        F.max((F.col(label_col) > 0).cast("int")).alias("_label"))
    present = known.join(docs.select(F.col(id_col).alias("_llm_id")).distinct(), "_llm_id", "left_semi")
    totals = {r[0]: r[1] for r in present.groupBy("_label").count().collect()}
    order = F.xxhash64("_llm_id", F.lit(settings.seed))
    # Two heads of a sort: each task sends at most the bound.
    few = [present.filter(F.col("_label") == y).orderBy(order, "_llm_id").limit(settings.sample_per_class)
           for y in (0, 1)]
    # Bounded by twice sample_per_class rows of two numbers.
    chosen = F.broadcast(few[0].union(few[1]))
    texts = docs.select(F.col(id_col).alias("_llm_id"), text_or_empty(text_col).alias("_text")).join(chosen, "_llm_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column(0):
                    w = read_words([t.as_py()])
                    rows.append((w.hashes.tobytes(), w.sentences.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), *[pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)]],
                    names=["label", "hashes", "sentences"])

    return texts.select("_text", "_label").mapInArrow(
        run, "label int, hashes binary, sentences binary").toArrow(), totals


def gradient(w: np.ndarray, bias: float, feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, y: np.ndarray,
             importance: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted log-loss of the documents' labels, by the words' weights and the bias.

    ``feature`` and ``sentence`` tell which word stands in which sentence, ``owner`` the document
    of each sentence.
    """
    z = bias + np.bincount(sentence, weights=w[feature], minlength=len(owner))
    clean = _all_clean(z, owner, len(y))
    toxic = -np.expm1(clean)
    # Noisy-or: blame of a sentence is its chance, times how surprising a toxic label is.
    blame = np.where(y == 1, -np.exp(clean) / np.maximum(toxic, 1e-12), 1.0) * importance
    slope = blame[owner] * np.exp(-np.logaddexp(0.0, -z))
    return np.bincount(feature, weights=slope[sentence], minlength=len(w)), float(slope.sum())


def fit_bags(bags: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings = Settings(),
             totals: dict[int, int] | None = None) -> Model:
    """The model of (label, word hashes, sentence numbers) per document.

    ``totals`` says how many documents of each label the bags stand for.
    """
    y = np.array([b[0] for b in bags], float)
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0, float(y.mean()) if len(y) else 0.0)
    known, support = np.unique(np.concatenate([np.unique(b[1]) for b in bags]), return_counts=True)
    vocabulary = known[support >= settings.least_documents]
    features, sentences, counts = [], [], []
    for _, hashes, own in bags:
        kinds, number = np.unique(own, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
        used = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        features.append(at[used])
        sentences.append(number[used] + sum(counts[-1:]))
        counts.append(len(kinds) + sum(counts[-1:]))  # sentences so far
    feature, sentence = np.concatenate(features), np.concatenate(sentences)
    owner = np.repeat(np.arange(len(bags)), np.diff(counts, prepend=0))
    del known, support, features, sentences
    w, bias = np.zeros(len(vocabulary)), _START_BIAS
    scale, bias_scale = np.full(len(w), 1e-12), 1e-12
    sizes = {1: int(y.sum()), 0: int(len(y) - y.sum())}
    shares = {k: (totals or sizes)[k] for k in sizes}
    importance = np.where(y == 1, shares[1] / sizes[1], shares[0] / sizes[0]) / sum(shares.values())
    l1 = settings.l1_documents * shares[1] / sizes[1] / sum(shares.values())
    for _ in range(settings.iterations):
        g, bias_g = gradient(w, bias, feature, sentence, owner, y, importance)
        scale += g * g
        step = settings.rate / np.sqrt(scale)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        bias_scale += bias_g * bias_g
        bias -= settings.rate / np.sqrt(bias_scale) * bias_g
    used = np.flatnonzero(w)
    return Model(vocabulary[used], w[used], bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """The model of the documents in ``docs`` that ``labels`` covers."""
    table, totals = _sample(docs, labels, id_col, text_col, label_col, settings)
    bags = [(label, np.frombuffer(hashes, np.uint64), np.frombuffer(sentences, "<u4").astype(np.int64))
            for label, hashes, sentences in zip(*[table.column(i).to_pylist() for i in range(3)])]
    del table
    bags.sort(key=lambda b: (b[0], len(b[1]), b[1].tobytes()))
    return fit_bags(bags, settings, totals)


def _scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, Words, np.ndarray]:
    """(score per text, its words, the logit of each sentence)."""
    words = read_words(texts)
    z = _sentence_logits(words, model)
    if model.constant is not None:
        return np.full(len(texts), model.constant), words, z
    return -np.expm1(_all_clean(z, words.owner, len(texts))) + 0.0, words, z


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with their own columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p, _, _ = _scores(part.column(at).to_pylist(), shared.value)
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, score, sentences, offending, worst_start, worst_end) of every row.

    ``offending`` counts sentences at or over the threshold; the worst sentence's span is
    null where there is no sentence.
    """
    columns = [id_col, *carry]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(len(columns)).to_pylist()
                p, words, z = _scores(texts, shared.value)
                order = np.lexsort((-words.starts, z, words.owner))
                worst = np.full(len(texts), -1)
                worst[words.owner[order]] = order  # the last one of each text stays
                none = worst < 0
                at = np.maximum(worst, 0)
                span = [pa.array(np.where(none, 0, x[at] if len(x) else 0), pa.int64(), mask=none)
                        for x in (words.starts, words.ends)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(columns))], pa.array(p),
                     pa.array(np.bincount(words.owner, minlength=len(texts)), pa.int64()),
                     pa.array(np.bincount(words.owner[z >= 0], minlength=len(texts)), pa.int64()), *span],
                    names=[*columns, "score", "sentences", "offending", "worst_start", "worst_end"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, text_or_empty(text_col).alias("_text")).mapInArrow(
        run, f"{schema}, score double, sentences long, offending long, worst_start long, worst_end long")


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                        threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, end, sentence, score) of the sentences at or over ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                words = read_words(texts)
                p = np.exp(-np.logaddexp(0.0, -_sentence_logits(words, shared.value)))
                hit = np.flatnonzero(p >= threshold) if shared.value.constant is None else []
                rows = [(int(words.owner[i]), int(words.starts[i]), int(words.ends[i])) for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([texts[o][a:b].strip() for o, a, b in rows], pa.string()),
                     pa.array([float(p[i]) for i in hit], pa.float64())],
                    names=[id_col, "start", "end", "sentence", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, start long, `end` long, sentence string, score double")
