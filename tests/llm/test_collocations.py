"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from actionloom.llm import collocations
from tests.llm.helpers import ODD, docs, empty

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def expected(rows, least, longest=4, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    found = []
    for lang, f in counts.items():
        kept = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        scored = []
        for w, a in kept.items():
            score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
            inside = any(100 * b >= 80 * a for v, b in kept.items() if len(v) > len(w)
                         and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)))
            if not inside:
                scored.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def texts(seed, n):
    r = random.Random(seed)
    words = ["The", "of", "a", "new", "york", "city", "été", "x\xa0y", "don't", "END", "in", "to"]
    fixed = ["new york city of", "in the end", "a to"]
    rows = []
    for i in range(n):
        parts = [r.choice(fixed) if r.random() < .3 else r.choice(words) for _ in range(r.randrange(30))]
        text = "".join(p + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?", "\r\n", " . "]) for p in parts)
        rows.append((i, text, r.choice(["en", "en", "en", "de", None, "und"])))
    return rows


def result(found):
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


@pytest.mark.parametrize("seed, least, chunk, fan_in", [(1, 5, 1 << 24, 32), (2, 3, 200, 3), (3, 12, 1000, 2)])
def test_against_plain_counts(spark, seed, least, chunk, fan_in):
    rows = texts(seed, 300)
    found = collocations.mine(docs(spark, rows).repartition(5), least=least, chunk_bytes=chunk, fan_in=fan_in)
    want = expected(rows, least)
    assert len(want) > 20 and result(found) == want


def test_top_and_length(spark):
    rows = texts(4, 200)
    assert result(collocations.mine(docs(spark, rows), least=4, longest=2, top=3)) == expected(rows, 4, 2, 3)


def test_odd_rows_and_empty_table(spark):
    assert result(collocations.mine(docs(spark, ODD), least=2)) == expected(ODD, 2)
    assert result(collocations.mine(empty(spark))) == []
    quiet = [(1, " .,;", "en"), (2, None, None)]
    assert result(collocations.mine(docs(spark, quiet), least=1)) == []


def test_same_text_thousands_of_times(spark):
    rows = [(i, "one and the same", "en") for i in range(3000)]
    assert result(collocations.mine(docs(spark, rows))) == [
        ("en", 1, "one and the same", 3000, 3000, 3000, 12000, 1_000_000)]


def test_tiles_of_all_sizes():
    r = np.random.default_rng(5)
    ids = np.concatenate([r.integers(0, 1 << k, 300) for k in range(1, 31)]).astype(np.int64)
    pairs = ids << 32 | r.permutation(ids)
    numbers = collocations._tile(pairs)
    for number in np.unique(numbers).tolist():
        tile, here = collocations.tile_of(number), pairs[numbers == number]
        left, right = here >> 32, here & 0xFFFFFFFF
        assert (left >= tile.left).all() and (left < tile.left + tile.height).all()
        assert (right >= tile.right).all() and (right < tile.right + tile.width).all()
        if tile.dense:
            assert (tile.pairs(tile.cells(here)) == here).all()


@pytest.mark.parametrize("most", [50, 2000])
def test_dense_and_sparse_counts_agree(most):
    r = np.random.default_rng(most)
    pairs = r.integers(0, most, 70_000) << 32 | r.integers(0, most, 70_000)
    pairs = pairs[collocations._tile(pairs) == 0]
    tile = collocations.tile_of(0)
    dense = collocations.count_tile(tile, pairs)
    sparse = np.unique(pairs, return_counts=True)
    twice = collocations.count_tile(tile, np.concatenate([dense[0], dense[0]]), np.concatenate([dense[1], dense[1]]))
    for got, factor in ((dense, 1), (twice, 2)):
        assert np.array_equal(got[0], sparse[0]) and np.array_equal(got[1], sparse[1] * factor)
