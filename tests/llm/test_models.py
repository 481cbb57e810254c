import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from actionloom.llm import cross_polytope, interpolated_lm, language, queries, toxicity
from actionloom.llm.common import held_out
from tests.llm.helpers import ODD, SF, crc, docs, empty

EN, DE = "the cat and the dog are in the house with them", "der hund und die katze sind in dem haus mit ihnen"


# --- Language -----------------------------------------------------------------------

def _speech(n):
    rows = []
    for i in range(n):
        words = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(words[(i * 7 + k * k) % len(words)] for k in range(12)), "en" if i % 2 else "de"))
    return rows


def test_language_learns_and_predicts(spark):
    model = language.fit(docs(spark, _speech(120)))
    assert model.languages == ["de", "en"]
    rows = [(1, EN.upper(), None), (2, DE, None), (3, None, None), (4, "12 -- 3 !", None), (5, "", None),
            (None, "the house", None), (6, "x" * (1 << 20) + " the", "en")]
    found = {r.doc_id: r for r in language.predict(docs(spark, rows), model).collect()}
    assert (found[1].lang_pred, found[2].lang_pred, found[None].lang_pred) == ("en", "de", "en")
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in found.values()) and found[6].lang_pred in ("en", "de")


def test_language_does_not_depend_on_the_batch(spark):
    model = language.fit(docs(spark, _speech(60)))
    texts = [EN, "!", None, DE, "", "the und"]
    together, _ = language._scores(texts, model)
    alone = np.concatenate([language._scores([t], model)[0] for t in texts])
    assert np.allclose(together, alone)


def test_language_weights_are_sparse_and_idf_counts_all_rows(spark):
    df = docs(spark, _speech(80))
    frequencies, n = language.document_frequencies(df, "text")
    want = Counter(b for _, t, _ in _speech(80) for b in set(language.text_buckets(t).tolist()))
    assert n == 80 and {i: int(c) for i, c in enumerate(frequencies) if c} == dict(want)
    model = language.fit(df)
    assert 0 < np.count_nonzero(model.weights) < 0.2 * model.weights.size


def test_temperature_is_the_best_of_a_grid():
    draw = np.random.default_rng(1)
    labels = draw.integers(3, size=400)
    logits = draw.normal(size=(400, 3)) * 4
    logits[np.arange(400), labels] += 2
    t = language.fit_temperature(logits, labels)
    loss = lambda x: -np.log(language._softmax(logits / x)[np.arange(400), labels]).mean()
    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (0.5, 0.9, 1.1, 2))


def test_language_without_labels_or_rows(spark):
    assert language.fit(empty(spark)) is None
    assert language.fit(docs(spark, [(1, "x", None)])) is None
    found = language.predict(docs(spark, ODD), None).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)} and len(found) == len(ODD)
    model = language.fit(docs(spark, ODD))
    assert language.predict(empty(spark), model).count() == 0
    kept = language.keep_identified(docs(spark, ODD), model, 0.0)
    assert kept.schema.names == docs(spark, ODD).schema.names
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, _ in ODD)


def test_language_held_out_accuracy(spark):
    found = queries.queries()["op1_language_id"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


# --- Toxicity -----------------------------------------------------------------------

def _bags(n):
    """Documents of some sentences; a toxic one has one sentence with a bad word."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        sentences = [" ".join(draw.choice(EN.split(), 6)) for _ in range(5)]
        if i % 3 == 0:
            sentences[i % 5] += " rotten" if i % 2 else " Vileness"
        rows.append((i, ". ".join(sentences) + ".", "en"))
    return rows


def test_toxicity_finds_documents_and_sentences(spark):
    rows = _bags(240)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows] + [(None, 1), (5, None)],
                                   "doc_id long, toxic int")
    df = docs(spark, rows)
    model = toxicity.fit(df, labels)
    odd = docs(spark, [(1, "the cat. the vileness. the dog", None), (2, None, None), (3, "", None), (4, "the cat", None),
                       (4, "the cat", None), (None, "rotten", None), (6, "the dog and cat " * 40000, None)])
    found = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert found[1].score > 0.5 > found[4].score and found[None].score > 0.5 > found[6].score
    assert found[2].score == found[3].score == 0.0 and found[2].worst_start is None
    assert "vileness" in "the cat. the vileness. the dog"[found[1].worst_start:found[1].worst_end]
    said = toxicity.offending_sentences(odd.filter("doc_id = 1"), model).collect()
    assert [(r.doc_id, r.sentence) for r in said] == [(1, "the vileness")]
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 4, 6]


def test_noisy_or_of_sentence_scores(spark):
    model = toxicity.Model(np.sort(toxicity.read_words(["bad"]).hashes), np.array([2.0]), -1.0)
    p, _, z = toxicity._scores(["good. bad. bad bad", "fine"], model)
    each = 1 / (1 + np.exp(-np.array([-1.0, 1.0, 3.0])))
    assert p[0] == pytest.approx(1 - np.prod(1 - each)) and p[1] == pytest.approx(each[0])
    assert z.tolist() == [-1.0, 1.0, 3.0, -1.0]


def test_words_do_not_depend_on_the_batch():
    texts = ["One two. Three!\nfour", None, "...", "Émile fünf", "a" * 70 + " b"]
    together = toxicity.read_words(texts)
    for i, t in enumerate(texts):
        alone, mine = toxicity.read_words([t]), together.owner[together.sentences] == i
        assert sorted(alone.hashes) == sorted(together.hashes[mine])
        assert alone.starts.tolist() == together.starts[together.owner == i].tolist()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, ODD), none)
    assert {r.score for r in toxicity.score(docs(spark, ODD), model).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.fit(empty(spark), none).constant == 0.0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.queries()["op4_toxicity"](spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)
    clean = [r for r in found if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


# --- Language model -----------------------------------------------------------------

def test_language_model_against_plain_counts(spark):
    rows = [(i, t, None) for i, (_, t, _) in enumerate(ODD)] + [(100 + i, t, None) for i, t, _ in _speech(40)] + [
        (None, "the cat", None)]
    df = docs(spark, rows).withColumn("held_out", held_out("doc_id", 7, 2))
    found = {(r.doc_id, r.n_tokens): r for r in interpolated_lm.score(df, block_bytes=500).collect()}
    assert len(found) == len(rows)
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"])
              for i, t, _ in rows]
    train = [x for i, x in tokens if i is None or crc(i, 7) != 2]
    count = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip(["<s>", *x], x))
    total, distinct = sum(count.values()), len(count)
    # The weights from the deleted counts, over unbinned estimates.
    cells = []
    for x in train:
        for a, b in zip(["<s>", *x], x):
            context = (len(train) if a == "<s>" else count[a]) - 1
            q = (pairs[a, b] - 1) / context if context else 0.0
            cells.append((int(interpolated_lm._bucket_of(np.array([context]))[0]),
                          *(int(interpolated_lm._bins(np.array([v]))[0]) for v in ((count[b] - 1) / (total - 1), q)), 1))
    weights = interpolated_lm.learn_weights(cells, 2, 1 / (distinct + 1))
    for i, x in tokens:
        r = found[i, len(x)]
        assert (r.n_known, r.train_tokens, r.held_out) == (sum(w in count for w in x), total, i is not None and crc(i, 7) == 2)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in x))
        want = 0.0
        for a, b in zip(["<s>", *x], x):
            context = len(train) if a == "<s>" else count[a]
            w = weights[interpolated_lm._bucket_of(np.array([context]))[0]]
            want += math.log10(w[0] / (distinct + 1) + w[1] * count[b] / total + (w[2] * pairs[a, b] / context if context else 0))
        assert r.score == pytest.approx(want)


def test_weights_climb_in_likelihood():
    cells = [(1, 40, 9, 50), (1, 60, 0, 30), (2, 30, 5, 20), (2, 80, 3, 5)]
    q = lambda c: np.array([0.01, *interpolated_lm._center(np.array(c[1:3]))])
    fit = lambda w: sum(c[3] * math.log(float(q(c) @ w[c[0]])) for c in cells)
    few, many = (interpolated_lm.learn_weights(cells, 2, 0.01, n) for n in (1, 100))
    assert fit(many) >= fit(few) and np.allclose(many.sum(axis=1), 1) and many[0, 2] == 0


@pytest.mark.parametrize("numbers", [[], [0], [1, 255, 256], [2**63 + 5, 0, 7]])
def test_packing_numbers(numbers):
    x = np.array(numbers, np.uint64)
    assert interpolated_lm.unpack(interpolated_lm.pack(x)).tolist() == numbers
    assert interpolated_lm.unpack_sorted(interpolated_lm.pack_sorted(np.sort(x))).tolist() == sorted(numbers)


def test_language_model_of_no_rows_or_no_training(spark):
    none = empty(spark).withColumn("held_out", F.lit(False))
    assert interpolated_lm.score(none).count() == 0
    all_held = docs(spark, ODD).withColumn("held_out", F.lit(True))
    found = interpolated_lm.score(all_held, order=3).collect()
    assert len(found) == len(ODD) and all(r.score == 0.0 and r.n_known == 0 and r.train_tokens == 0 for r in found)


# --- Neighbours ---------------------------------------------------------------------

def _brute(rows, k, queries_of):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = {}
    for i, v in good:
        if queries_of(i):
            scores = sorted((-round(float(v @ u) / float(np.linalg.norm(v) * np.linalg.norm(u)), 9), j) for j, u in good if j != i)
            found[i] = [(j, -s) for s, j in scores[:k]]
    return found


def test_neighbours_of_odd_vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(30)] + [(50 + 150, [-0.0, 0.0, 0.0, 1.0]), (250, [0.0, 0.0, 0.0, 2.0])]
    rows += [(300, None), (301, [0.0] * 4), (350, [math.nan, 0.0, 0.0, 1.0]), (400, [1.0, None, 0.0, 0.0]),
             (450, [math.inf, 0.0, 0.0, 1.0]), (500, [1.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    settings = cross_polytope.Settings(tables=8, probes=8, part_vectors=7)  # all axes: the search is complete
    found = {}
    for r in cross_polytope.neighbours(df, F.col("vec_id") % 50 == 0, 5, settings=settings).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    want = _brute(rows, 5, lambda i: i % 50 == 0)
    assert found.keys() == want.keys()
    for i in want:
        assert [s for _, s in found[i]] == pytest.approx([s for _, s in want[i]], abs=1e-8)
    assert found[100] == [(101 + i, pytest.approx(1.0)) for i in range(5)]


def test_neighbours_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert cross_polytope.neighbours(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert cross_polytope.neighbours(one, F.lit(True)).count() == 0


def test_few_vectors_are_all_met(spark):
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.normal(size=64)]) for i in range(4)]
    found = cross_polytope.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True))
    assert sorted((r.query_id, r.vec_id) for r in found.collect()) == [(i, j) for i in range(4) for j in range(4) if i != j]


def test_neighbours_meet_in_blocks_without_moving_vectors_by_table(spark):
    """Blocks and parts give the search in one piece; nothing that holds a vector for each bucket is broadcast."""
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in draw.normal(size=16)]) for i in range(400)]
    rows += [(i + 1, v) for i, v in rows[:40]]  # repeated ids with other vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = lambda **params: cross_polytope.neighbours(df, F.col("vec_id") % 3 == 0, 5, settings=cross_polytope.Settings(**params))
    whole, blocks = ask(part_vectors=1000), ask(part_vectors=50)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert not any("_v#" in line for line in plan.splitlines() if "BroadcastExchange" in line)
    assert "explode(_cells" not in plan
    seen = [sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in f.collect()) for f in (whole, blocks)]
    assert seen[0] == seen[1] and len(seen[0]) > 500


def test_hadamard_turns_without_stretching():
    x = np.random.default_rng(2).normal(size=(5, 16))
    y = cross_polytope.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(cross_polytope.hadamard(y), x)


@pytest.mark.parametrize("scale", ["0.01", "0.1"])  # at the second every table is asked the least number of axes
def test_recall_of_the_query(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in table], float)
    ids, x = np.array([r.vec_id for r in table]), x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in queries.queries()["op7_cross_polytope"](spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = x @ x[at]
        s[at] = -2
        hits += len(found[ids[at]] & set(ids[np.lexsort((ids, -s))[:5]]))
        total += 5
    assert hits >= 0.9 * total


def test_unlabelled_corpus_stays(spark):
    rows = docs(spark, [(1, "some words", None), (2, None, None)])
    model = language.fit(rows)
    assert model is None and language.keep_identified(rows, model, 0.4).count() == 2


def test_leader_against_a_loop_over_coordinates():
    """Follow-the-regularised-leader with a dictionary per weight, against the array form."""
    settings = language.Settings()
    rng, classes = np.random.default_rng(1), 3
    model = language.Ftrl(20, classes, settings)
    z, n = {}, {}

    def weight(i, c):
        if abs(z.get((i, c), 0.0)) <= settings.l1:
            return 0.0
        sign = 1 if z[i, c] > 0 else -1
        return -(z[i, c] - sign * settings.l1) / ((settings.beta + n[i, c] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(200):
        rows = rng.choice(20, size=4, replace=False)
        x, label = rng.random(4) * 3, int(rng.integers(classes))
        scores = [sum(v * weight(i, c) for i, v in zip(rows, x)) for c in range(classes)]
        top = max(scores)
        total = sum(math.exp(s - top) for s in scores)
        for c in range(classes):
            error = math.exp(scores[c] - top) / total - (c == label)
            for i, v in zip(rows, x):
                w, g, before = weight(i, c), v * error, n.get((i, c), 0.0)
                z[i, c] = z.get((i, c), 0.0) + g - ((before + g * g) ** 0.5 - before ** 0.5) / settings.alpha * w
                n[i, c] = before + g * g
        model.learn(rows, x, label)
    want = np.array([[weight(i, c) for c in range(classes)] for i in range(20)])
    assert np.allclose(model.weights(slice(None)), want, atol=1e-12) and (want != 0).any()


def test_gradient_of_noisy_or_against_differences():
    rng = np.random.default_rng(2)
    owner = np.array([0, 0, 1, 2, 2, 2, 3])
    sentence, feature = rng.integers(0, 7, 60), rng.integers(0, 9, 60)
    y, importance = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.7, 1.3, 0.4, 2.0])
    w, bias = rng.normal(size=9) * 0.5, -1.2

    def loss(w, bias):
        total = 0.0
        for d in range(4):
            clean = 1.0
            for s in np.flatnonzero(owner == d):
                z = bias + sum(w[f] for f, t in zip(feature, sentence) if t == s)
                clean *= 1 - 1 / (1 + math.exp(-z))
            total -= importance[d] * math.log(1 - clean if y[d] else clean)
        return total

    g, bias_g = toxicity.gradient(w, bias, feature, sentence, owner, y, importance)
    h = 1e-6
    step = lambda i: np.eye(9)[i] * h
    assert np.allclose(g, [(loss(w + step(i), bias) - loss(w - step(i), bias)) / 2 / h for i in range(9)], atol=1e-6)
    assert bias_g == pytest.approx((loss(w, bias + h) - loss(w, bias - h)) / 2 / h, abs=1e-6)


def test_slices_are_bounded_by_bytes():
    from actionloom.llm.common import slices

    batch = pa.record_batch([pa.array(["x" * (50_000 if i % 3 else 9_000_000) for i in range(20)] + ["y"] * 600)], names=["t"])
    parts = list(slices(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows <= 256 and (p.num_rows == 1 or p.nbytes <= 4 << 20) for p in parts)
