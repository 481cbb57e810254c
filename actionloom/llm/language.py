"""Language identification by a sparse multinomial logistic regression.

Features are lower-case character n-grams with runs of other characters as one space,
hashed to a fixed number of buckets and weighted by relative frequency times inverse
document frequency. Document frequencies are counted over all training documents. The
weights are fitted with follow-the-regularised-leader and elastic-net penalties on a
sample of at most about ``sample_per_language`` documents per language, and a temperature
is fitted on a part of the sample that the weights have not seen.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is
everything if there is no labelled document. Rows without a language label are predicted
but not learned from. Repeated rows count as often as they occur. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionloom.llm.codepoints import cut, points, tables
from actionloom.llm.common import slices, text_or_empty

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
UNKNOWN = "und"
#: Brings relative frequencies to a size at which the default penalties fit.
FEATURE_SCALE = 30.0
SAMPLE_PER_LANGUAGE = 800
_MULTIPLIER, _MIXER = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@dataclass(frozen=True)
class Settings:
    """Penalties and step sizes of the fit, and the bound of its sample."""

    sample_per_language: int = SAMPLE_PER_LANGUAGE
    calibration_share: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    seed: int = 42


@dataclass(frozen=True)
class Model:
    """languages, weights (buckets x languages, idf included), intercepts, temperature."""

    languages: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one stream of lower-case letters and single spaces, and their bounds.

    Every text starts with a space of its own, so a text gives the same n-grams in any batch.
    """
    letter, _, lower = tables()
    stream = lower[points(" " + " ".join(texts) + " ")]
    is_letter = letter[stream]
    marks = np.cumsum([0, *[len(t) + 1 for t in texts]])
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[marks] = True
    bounds = np.cumsum(keep)[marks] - 1
    return np.where(is_letter, stream, np.uint32(32))[keep], bounds


def _buckets(stream: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position where one can start."""
    n = len(stream) - order + 1
    h = stream[:n].copy()
    for k in range(1, order):
        h = h * _MULTIPLIER + stream[k:n + k]
    h = (h + np.uint32(order)) * _MIXER
    return ((h ^ (h >> np.uint32(15))) * _MULTIPLIER) >> np.uint32(32 - BUCKET_BITS)


def _ngrams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, buckets, bounds per text); the n-grams of a text lie within its bounds."""
    stream, bounds = _letters(texts)
    for order in ORDERS:
        if len(stream) >= order:
            yield order, _buckets(stream, order), bounds


def _pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Texts cut into pieces, and the text of each piece."""
    found = [(i, piece) for i, t in enumerate(texts) for _, piece in cut(t or "")]
    return [p for _, p in found], np.array([i for i, _ in found], np.int64)


def text_buckets(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of one text, repeats included."""
    pieces, _ = _pieces([text])
    parts = [b[lo:max(lo, hi - order + 1)] for p in pieces for order, b, (lo, hi) in _ngrams([p])]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(documents per bucket, documents), over all rows; 2**BUCKET_BITS numbers reach the driver."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                flags = np.zeros(size, bool)
                flags[text_buckets(t.as_py())] = True
                seen += flags
                rows += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(seen[used], rows))], names=["bucket", "n"])

    counts = docs.select(text_or_empty(text_col).alias("_text")).mapInArrow(run, "bucket long, n long")
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    frequencies = np.zeros(size, np.int64)
    frequencies[bucket[bucket >= 0]] = n[bucket >= 0]
    return frequencies, int(n[bucket < 0].sum())


def _sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, settings: Settings) -> pa.Table:
    """(lang, chance, buckets, counts): features of a sample of about the same size per language."""
    sizes = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    if not sizes:
        return pa.table({"lang": pa.array([], pa.string()), "chance": pa.array([], pa.float64()),
                         "buckets": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
    rates = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, settings.sample_per_language / n))])
    chance = F.pmod(F.xxhash64(id_col, F.lit(settings.seed)), F.lit(1 << 20)) / (1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [np.unique(text_buckets(t.as_py()), return_counts=True) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([b.astype("<u4").tobytes() for b, _ in found], pa.binary()),
                     pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                    names=["lang", "chance", "buckets", "counts"])

    chosen = docs.select(F.col(lang_col).alias("_lang"), chance.alias("_chance"), text_or_empty(text_col).alias("_text"))
    chosen = chosen.withColumn("_rate", rates[F.col("_lang")]).filter("_chance < _rate")
    # The place within the chosen rows decides the part, evenly for every language.
    return chosen.select("_lang", (F.col("_chance") / F.col("_rate")).alias("_chance"), "_text").mapInArrow(
        run, "lang string, chance double, buckets binary, counts binary").toArrow()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, one weight per feature and class, elastic net."""

    def __init__(self, features: int, classes: int, settings: Settings):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.s = settings

    def weights(self, rows) -> np.ndarray:
        z, s = self.z[rows], self.s
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0)
        return -shrunk / ((s.beta + np.sqrt(self.n[rows])) / s.alpha + s.l2)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        error = _softmax(x @ w)
        error[label] -= 1.0
        g = x[:, None] * error
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / self.s.alpha * w
        self.n[rows] = grown


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log-loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / math.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    lo, hi, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        settings: Settings = Settings()) -> Model | None:
    """The model of ``train``'s rows that have a language; ``None`` if there are none.

    ``id_col`` only decides which rows are sampled.
    """
    labelled = train.filter(F.col(lang_col).isNotNull())
    sample = _sample(labelled, text_col, lang_col, id_col, settings)
    languages = sorted(set(sample.column("lang").to_pylist()))
    if not languages:
        return None
    frequencies, documents = document_frequencies(labelled, text_col)
    idf = np.log((1.0 + documents) / (1.0 + frequencies)) + 1.0
    rows = []
    for lang, chance, buckets, counts in zip(*[sample.column(i).to_pylist() for i in range(4)]):
        b, n = np.frombuffer(buckets, "<u4"), np.frombuffer(counts, "<u4")
        if len(b):
            x = FEATURE_SCALE * n / n.sum() * idf[b]
            rows.append((chance, languages.index(lang), np.append(b, 1 << BUCKET_BITS), np.append(x, 1.0)))
    rows.sort(key=lambda r: (r[0], r[1]))
    held = [r for r in rows if r[0] < settings.calibration_share]
    learned = [r for r in rows if r[0] >= settings.calibration_share] or rows
    ftrl = Ftrl((1 << BUCKET_BITS) + 1, len(languages), settings)
    order = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for i in order.permutation(len(learned)):
            _, label, b, x = learned[i]
            ftrl.learn(b, x, label)
    weights = ftrl.weights(slice(None))
    logits = np.array([x @ weights[b] for _, _, b, x in held]).reshape(len(held), len(languages))
    temperature = fit_temperature(logits, np.array([r[1] for r in held], int))
    scaled = (FEATURE_SCALE * idf[:, None] * weights[:-1]).astype(np.float32)
    return Model(languages, scaled, weights[-1], temperature)


def _scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(logits at the temperature, whether the text has a letter)."""
    pieces, owner = _pieces(texts)
    sums = np.zeros((len(texts), len(model.languages)))
    totals, has_letter = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for order, buckets, bounds in _ngrams(pieces):
        lo = bounds[:-1]
        hi = np.maximum(lo, bounds[1:] - order + 1)
        cumulative = np.zeros((len(buckets) + 1, len(model.languages)))
        np.cumsum(model.weights[buckets], axis=0, dtype=np.float64, out=cumulative[1:])
        np.add.at(sums, owner, cumulative[hi] - cumulative[lo])
        np.add.at(totals, owner, hi - lo)
        if order == 1:  # more than the leading space
            np.logical_or.at(has_letter, owner, hi - lo > 1)
    logits = (sums / np.maximum(totals, 1)[:, None] + model.intercepts) / model.temperature
    return logits, has_letter


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, lang_pred, score) of every row."""
    columns = [id_col, *carry]
    if model is None:
        return docs.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for batch in batches:
            for part in slices(batch):
                logits, known = _scores(part.column(len(columns)).to_pylist(), shared.value)
                p = _softmax(logits)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(columns))],
                     pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
                     pa.array(np.where(known, p[np.arange(len(best)), best], 0.0))],
                    names=[*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, text_or_empty(text_col).alias("_text")).mapInArrow(
        run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language of at least ``least_score``, with their own columns.

    Without a model, as no row was labelled, there is nothing to reject by: all rows stay.
    """
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                logits, known = _scores(part.column(at).to_pylist(), shared.value)
                yield part.filter(pa.array(known & (_softmax(logits).max(axis=1) >= least_score)))

    return docs.mapInArrow(run, docs.schema)
