import itertools

import numpy as np
import pytest

from actionloom.llm import queries, transcripts
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn int, line int, text string, role string, begins boolean, marker string, _conv long"


def _lines(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


TALK = [(c, t, n, text, role, n == 0)
        for c in range(12) for t, (role, lines) in enumerate([
            ("user", ["User: Can you help?", "I lost my key"]), ("assistant", ["Assistant: Look under the mat."]),
            ("user", ["Thanks a lot"]), ("assistant", ["AI: You are welcome", "> quoted", "Bye"])])
        for n, text in enumerate(lines)]


def _best(model, table):
    """The best path by trying all of them."""
    e = transcripts._emissions(table, model)
    score = lambda p: model.start[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(
        model.move[a, b] for a, b in zip(p, p[1:]))
    return max(itertools.product(range(model.states), repeat=len(e)), key=score)


def test_decoding_against_all_paths(spark):
    model = transcripts.fit(_lines(spark, TALK))
    seen = transcripts.observe(_lines(spark, TALK[:6]), "text").toArrow()
    e = transcripts._emissions(seen, model)
    assert tuple(transcripts.decode(e, model.start, model.move, None)) == _best(model, seen)
    m = transcripts.best_matrix(e, model.move)
    step = np.full((model.states, model.states), -np.inf)
    np.fill_diagonal(step, 0)
    for x in e:
        step = (step[:, :, None] + model.move[None]).max(axis=1) + x
    assert np.allclose(m, step)


@pytest.mark.parametrize("slice_lines", [1, 2, 5, 1000])
def test_slices_do_not_change_the_result(spark, slice_lines):
    model = transcripts.fit(_lines(spark, TALK))
    one_long = [(1, t, n, text, role, b) for c, t, n, text, role, b in TALK for t in [t + 4 * c]]
    rows = [*one_long, (2, 0, 0, None, None, None), (2, 0, 1, "x " * 9000, None, None), (None, 0, 0, "Q: why?", None, None),
            (3, 0, 0, "Hi", None, None), (3, 0, 0, "Hi", None, None)]
    key = lambda r: (r.conv_id or -1, r.turn, r.line)
    found = sorted(transcripts.parse(_lines(spark, rows), model, slice_lines=slice_lines).collect(), key=key)
    whole = sorted(transcripts.parse(_lines(spark, rows), model, slice_lines=10**6).collect(), key=key)
    assert found == whole and len(found) == len(rows)
    own = [r for r in found if r.conv_id == 1]
    truth = sorted(one_long)
    assert sum(r.role_pred == t[4] for r, t in zip(own, truth)) >= 0.9 * len(own)
    assert sum(r.rendered.endswith("<|end|>") for r in own) == 1 and own[-1].rendered.endswith("\n<|end|>")
    assert own[0].rendered == "<|user|>\nCan you help?"


def test_nothing_to_parse_or_learn(spark):
    model = transcripts.fit(_lines(spark, TALK))
    assert transcripts.parse(_lines(spark, TALK).limit(0), model).count() == 0
    with pytest.raises(ValueError):
        transcripts.fit(_lines(spark, TALK).limit(0))


def test_held_out_accuracy(spark):
    truth = queries.transcript_lines(spark.read.parquet(f"{SF}/conversations.parquet")).withColumnRenamed("text", "raw")
    found = queries.queries()["op2_transcript_parsing"](spark, SF)
    rows = found.join(truth, ["conv_id", "turn", "line"]).filter("held_out").collect()
    assert found.count() == truth.count()
    assert sum(r.role == r.role_pred for r in rows) >= 0.85 * len(rows)


def test_only_true_markers_go(spark):
    """Rendered lines without the headers are the raw lines but for the markers of speakers."""
    raw = ["User: Note: keep it safe", "Warning: hot", "https://example.org", "    indented: code", "  * Tip : x ",
           "Q: a: b"]
    talk = [(50, 0, n, text, "user", n == 0) for n, text in enumerate(raw)]
    model = transcripts.fit(_lines(spark, TALK))
    found = sorted(transcripts.parse(_lines(spark, talk), model).collect(), key=lambda r: r.line)
    import re
    for r, text in zip(found, raw):
        plain = re.sub(r"<\|end\|>$", "", re.sub(r"^<\|\w+\|>\n", "", r.rendered)).removesuffix("\n")
        marker = re.match(r"(User|Q): ", text) if r.begins_pred else None
        assert plain == text[marker.end() if marker else 0:], (plain, text)
    assert found[0].begins_pred and found[0].rendered.endswith("\nNote: keep it safe")


def test_counts_of_fit(spark):
    """Starts and transitions against a plain count; repeated rows and later first turns too."""
    shifted = [(c, t + 3, n, text, role, b) for c, t, n, text, role, b in TALK]
    model = transcripts.fit(_lines(spark, shifted + shifted[:6] * 30))
    roles = sorted({r[4] for r in TALK})
    states = [roles.index(r[4]) + len(roles) * r[5] for r in shifted]
    move, start = np.ones((4, 4)), np.ones(4)
    for a, b, x, y in zip(shifted, shifted[1:], states, states[1:]):
        if a[0] == b[0]:
            move[x, y] += 1
    for r, s in zip(shifted, states):
        start[s] += r[1] == 3 and r[2] == 0
    assert model.roles == roles
    assert np.allclose(np.exp(model.move), move / move.sum(axis=1, keepdims=True))
    assert np.allclose(np.exp(model.start), start / start.sum())
