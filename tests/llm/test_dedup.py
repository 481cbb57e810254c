import hashlib
import re

import pytest
import xxhash

from actionloom.llm import exact_dedup, simhash
from actionloom.llm.components import connected_components
from tests.llm.helpers import ODD, docs, empty


def test_components_against_union_find(spark):
    edges = [(i * 7 % 90, i * 13 % 90) for i in range(60)] + [(200, i) for i in range(201, 240)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(
        spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert found == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def _exact(rows):
    groups = {}
    for at, (i, t, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, at))
    best = {k: min(v) for k, v in groups.items()}
    return groups, best


def test_exact_groups_of_odd_rows(spark):
    found = exact_dedup.duplicate_groups(docs(spark, ODD)).collect()
    groups, best = _exact(ODD)
    assert len(found) == len(ODD) and sum(r.kept for r in found) == len(groups)
    want = sorted((i, best[k][2] if not best[k][1] else None, len(groups[k]))
                  for k in groups for _, null, i, _ in groups[k] for i in [None if null else i] if i is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found if r.doc_id is not None) == want


def test_longest_then_smallest_id_stays(spark):
    rows = [(5, "a b", None), (4, "a  b", None), (3, "ab", None), (9, "a  b", None), (1, "c", None)]
    found = {r.doc_id: r for r in exact_dedup.duplicate_groups(docs(spark, rows)).collect()}
    assert {i: found[i].keep_id for i in found} == {5: 4, 4: 4, 3: 4, 9: 4, 1: 1}
    assert [i for i in sorted(found) if found[i].kept] == [1, 4]


def test_same_length_and_prefix_but_other_text(spark):
    rows = [(1, "p" * 100 + "a", None), (2, "p" * 100 + "b", None), (3, "p" * 100 + " a", None)]
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(docs(spark, rows)).collect()}
    assert found == {1: (3, 2), 3: (3, 2), 2: (2, 1)}


def test_bit_table_of_one_slot_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TABLE_BITS", 0)
    rows = [(1, "a", None), (2, "a ", None), (3, "b", None)]
    found = {r.doc_id: r.keep_id for r in exact_dedup.duplicate_groups(docs(spark, rows)).collect()}
    assert found == {1: 2, 2: 2, 3: 3}


def test_carry_and_digest(spark):
    df = docs(spark, ODD).withColumn("text_sha256", exact_dedup.digest())
    found = exact_dedup.duplicate_groups(df, carry=["text_sha256"]).filter("doc_id = 1").first()
    assert found.text_sha256 == hashlib.sha256(b"Thesametext").hexdigest()


def test_exact_native_and_empty(spark):
    frame = exact_dedup.duplicate_groups(empty(spark))
    assert frame.count() == 0 and exact_dedup.drop_duplicates(empty(spark)).count() == 0
    plan = exact_dedup.duplicate_groups(docs(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_drop_duplicates_keeps_columns_and_one_of_repeated_rows(spark):
    df = docs(spark, ODD)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.schema.names == df.schema.names
    assert kept.count() == len(_exact(ODD)[0])


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "one", "One TWO ÄÖ three", "a b c d e f g a b c d " * 9, " \x0bx\x1cy "])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == _fingerprint(text)


def _classes(fps, bits):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 7])
def test_links_connect_what_all_pairs_connect(spark, bits):
    import random
    draw = random.Random(bits)
    centres = [draw.getrandbits(64) for _ in range(12)]
    fps = [0, (1 << 64) - 1]
    for c in centres:  # chains and crowds around every centre
        step = c
        for _ in range(25):
            for _ in range(draw.randint(0, bits + 1)):
                step ^= 1 << draw.randrange(64)
            fps.append(step if draw.random() < 0.5 else c ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    counted = spark.createDataFrame([(f, 1 + f % 3) for f in signed], "fp long, n long")
    found = simhash.links(counted, bits).collect()
    at = {f: i for i, f in enumerate(signed)}
    label = list(range(len(fps)))
    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits
        lo, hi = sorted((label[at[r.a]], label[at[r.b]]))
        label = [lo if x == hi else x for x in label]
    assert label == _classes(fps, bits)


def test_near_duplicates_of_odd_rows(spark):
    found = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    fps = [_fingerprint(t) for _, t, _ in ODD]
    label = _classes(fps, 4)
    ids = [i for i, _, _ in ODD]
    least = {k: min((i for i, c in zip(ids, label) if c == k and i is not None), default=None) for k in set(label)}
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or 0)
    assert sorted(((r.doc_id, r.component_id) for r in found), key=order) == sorted(
        ((i, least[c]) for i, c in zip(ids, label)), key=order)


def test_keep_one_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = docs(spark, [(3, text, None), (1, text + " end", None), (2, "quite another text of some words", None)])
    kept = simhash.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == df.columns
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_columns_named_like_the_helpers_stay(spark):
    rows = spark.createDataFrame(
        [(1, "one two three four five", 71, 81), (2, "one two three four five", 72, 82), (3, "else", 73, 83)],
        "doc_id long, text string, _llm_id long, _llm_row long")
    kept = {1: (71, 81), 3: (73, 83)}
    assert {r.doc_id: (r._llm_id, r._llm_row) for r in simhash.keep_one(rows).collect()} == kept
    assert {r.doc_id: (r._llm_id, r._llm_row) for r in exact_dedup.drop_duplicates(rows).collect()} == kept
