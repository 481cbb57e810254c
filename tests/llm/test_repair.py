"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from actionloom.llm import conversation_repair as repair
from actionloom.llm import queries
from actionloom.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string, part int, conv string, n long, times string"
BLANK = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 5, "y") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected(rows):
    """The definitions, word by word, with a search over positions and states."""
    found = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in damage([r for r in rows if r[0] == conv])],
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.strip(BLANK)
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        n = len(mine)

        @lru_cache(maxsize=None)
        def best(i, last, room):
            """(cost, audit, lines) from row i on; ``last`` is the initial before; ``room`` insertions in a row."""
            ways = []
            after = "u" if last in ("", "s", "a") else "a"
            name = {"u": "user", "a": "assistant"}[after]
            if room:
                c, a, t = best(i, after, room - 1)
                ways.append((c + 2, "I" + a, (f"{name}:",) + t))
            if i == n:
                if last in ("", "a"):
                    ways.append((0, "", ()))
                return min(ways) if ways else (10 ** 9, "", ())
            _, role, text = mine[i]
            c, a, t = best(i + 1, last, 3)
            ways.append((c + 3, "D" + a, t))
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                c, a, t = best(i + 1, after, 3)
                ways.append((c + 2 + extra, "R" + a, (f"{name}:{text}",) + t))
                if role[:1] == after or (role[:1] == "s" and last == ""):
                    c, a, t = best(i + 1, role[:1], 3)
                    ways.append((c + extra, "K" + a, (f"{role}:{text}",) + t))
            return min(ways)

        cost, audit, lines = best(0, "", 3)
        turns = [r[0] for r in mine if r[0] is not None]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"),
            faults.count("t"), sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(mine, mine[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def result(df):
    edited = repair.repair(damaged(df), times_col="times")
    return {r.conv: tuple(r)[1:] for r in repair.digest(edited).collect()}


def random_rows(seed, conversations, most):
    r = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", " \n", "Go!\t", "Done. ", None, "été.", "a b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    return [(c, r.choice([t, t, t, r.randrange(most), None]), r.choice(roles), r.choice(texts) if r.random() < .4 else f"text {r.random()}.")
            for c in [*range(conversations), None] for t in range(r.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed):
    rows = random_rows(seed, 60, 14)
    assert result(table(spark, rows)) == expected(rows)


@pytest.mark.parametrize("size", [1, 3, 40])
def test_slices_do_not_change_the_result(spark, monkeypatch, size):
    rows = random_rows(7, 3, 30) + random_rows(8, 1, 90)
    want = expected(rows)
    cut = repair._cut
    # The tasks get the function by value, so the limit has to travel inside it.
    monkeypatch.setattr(repair, "_cut", lambda names: _limited(cut(names), size))
    assert result(table(spark, rows)) == want


def _limited(run, size):
    def limited(batches):
        repair_module = __import__("actionloom.llm.conversation_repair", fromlist=["x"])
        before, repair_module.SLICE_ROWS = repair_module.SLICE_ROWS, size
        try:
            yield from run(batches)
        finally:
            repair_module.SLICE_ROWS = before
    return limited


def test_long_runs_by_powers():
    for symbol in [("u", repair.FINE), ("a", repair.TRUNCATED), ("", repair.FINE), ("s", repair.FINE), repair.GONE]:
        one = repair._row_matrix(symbol)
        plain = one
        for n in range(1, 40):
            assert np.array_equal(repair.run_matrix(symbol, n), plain)
            for after in [(0, 4, 2, 0), (3, 0, 1, 2)]:
                want = tuple((plain + np.array(after)).min(axis=1).tolist())
                base, above = repair._before(symbol, n, 0, after) if min(after) == 0 else (0, ())
                if symbol != repair.GONE:
                    assert tuple(base + x for x in above) == want
            plain = repair.times(plain, one)


def test_hot_conversation_of_equal_rows(spark):
    """Rows that repeat thousands of times become one row with a count."""
    rows = [(1, 5, "user", "Same.")] * 3000 + [(1, 6, "assistant", "Fine.")] + [(2, 1, "user", "Hi.")]
    df = table(spark, rows).selectExpr("*", "1 AS once")
    edited = repair.repair(df, times_col="once")
    assert edited.filter("conv = 1").selectExpr("sum(size(roles))").first()[0] == 2
    got = {r.conv: r for r in repair.digest(edited).collect()}
    assert got[1].audit == "K" + "D" * 2999 + "K" and got[1].duplicate == 2999 and got[1].cost == 3 * 2999
    turns = repair.repaired_turns(edited).orderBy("conv", "part", "slice", "place").collect()
    assert [(t.role, t.text) for t in turns if t.conv == 1] == [("user", "Same."), ("assistant", "Fine.")]


def test_lost_rows_and_empty_table(spark):
    assert result(table(spark, [])) == {}
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = result(table(spark, [(lost, 0, "user", "Gone.")]))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_very_long_text(spark):
    rows = [(i, 0, "user", "x" * 300_000 + ".") for i in range(30)]
    got = repair.digest(repair.repair(table(spark, rows)))
    assert {r.audit for r in got.collect()} == {"IK"} or {r.audit for r in got.collect()} == {"KI"}


def test_registered():
    assert "op11_conversation_repair" in queries.queries() and "op11_conversation_repair" in queries.oracle_sql()
