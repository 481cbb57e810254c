"""Roles and turns of plain transcripts, by a hidden Markov model over their lines.

A state is a role and whether the line begins a turn. A line shows a speaker marker, if
any, and features of its text; given the state they are taken as independent. Start,
transition and emission counts come from labelled lines, with one added to each.

Decoding is Viterbi over whole transcripts of any length. Lines are range-partitioned, so
one transcript may lie in many slices. Each slice first reduces its outer transcripts to a
matrix of best path scores from state to state; along a transcript these matrices are few,
one per slice, and give the states at the cuts. Then every slice decodes its lines between
fixed states. No transcript is gathered into one row or one task.

Defined results: a null text is an empty line. Lines with equal keys are ordered by their
text; null ids form a transcript of their own. Unknown or null roles are not learned from,
and without any labelled line there is no model: ``fit`` raises. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionloom.llm.common import text_or_empty
from actionloom.session import stored

#: Speaker names before a colon, and the kind of marker they are. Fixed values.
MARKERS = {
    "user": "asker", "human": "asker", "question": "asker", "q": "asker", "customer": "asker",
    "assistant": "helper", "ai": "helper", "bot": "helper", "answer": "helper", "a": "helper", "agent": "helper",
    "system": "setting", "instruction": "setting", "context": "setting",
}
KINDS = ("none", "other", *sorted(set(MARKERS.values())))
_MARKER = r"^[\s>#*\[]*([A-Za-z][A-Za-z ]{0,19})[\]*]*\s*:[\s*]*"
FEATURES = ("marker", "length", "question", "opening", "quoted")
#: Lines of a slice, about.
SLICE_LINES = 100_000
_SORT = ["_conv", "_turn", "_line", "_text"]


@dataclass(frozen=True)
class Model:
    """roles; log scores: start by state, transition from state to state, emission per feature."""

    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]

    @property
    def states(self) -> int:
        return 2 * len(self.roles)  # continuing states first, then beginning ones


def observe(lines: DataFrame, text_col: str) -> DataFrame:
    """Add the small integer ``FEATURES`` of each line."""
    text = text_or_empty(text_col)
    name = F.lower(F.trim(F.regexp_extract(text, _MARKER, 1)))
    kinds = F.create_map(*[F.lit(x) for k, v in MARKERS.items() for x in (k, KINDS.index(v))])
    return lines.withColumns({
        "marker": F.when(name == "", 0).otherwise(F.coalesce(kinds[name], F.lit(1))),
        "length": F.least(F.lit(11), F.floor(F.log2(F.length(text) + 1)).cast("int")),
        "question": F.rtrim(text).endswith("?").cast("int"),
        "opening": F.rlike(text, F.lit(r"^\p{Lu}")).cast("int"),
        "quoted": F.rlike(text, F.lit(r"^\s*(>|```|[-*] )")).cast("int"),
    })


_SIZES = {"marker": len(KINDS), "length": 12, "question": 2, "opening": 2, "quoted": 2}


def without_marker(text: Column) -> Column:
    """The text after its speaker marker. Only for lines that begin a turn with a known speaker."""
    return F.regexp_replace(text, _MARKER, "")


def fit(lines: DataFrame, text_col: str = "text", role_col: str = "role", begins_col: str = "begins",
        order_cols: tuple[str, ...] = ("conv_id", "turn", "line")) -> Model:
    """Counts of labelled lines; a line's predecessor is the one before in ``order_cols``.

    Lines repeated under the same keys count once for starts and transitions. A conversation
    starts with its least turn, whatever its number.
    """
    seen = observe(lines.filter(F.col(role_col).isNotNull()), text_col)
    roles = [r[0] for r in seen.select(role_col).distinct().orderBy(role_col).collect()]
    if not roles:
        raise ValueError("no labelled line to learn from")
    places = F.create_map(*[F.lit(x) for i, r in enumerate(roles) for x in (r, i)])
    begins = F.col(begins_col).cast("int")
    states = 2 * len(roles)
    seen = seen.withColumn("_state", places[F.col(role_col)] + begins * len(roles))
    emit = {}
    for f in FEATURES:
        counts = np.ones((states, _SIZES[f]))
        for s, v, n in seen.groupBy("_state", f).count().collect():
            counts[s, v] += n
        emit[f] = np.log(counts / counts.sum(axis=1, keepdims=True))
    # The state before is that of the line before, or of the last line of the turn before.
    first, turn, line = order_cols
    seen = seen.groupBy(*order_cols).agg(F.min("_state").alias("_state"))
    ends = seen.groupBy(first, turn).agg(F.max_by("_state", line).alias("_before"), F.max(line).alias("_top"))
    inner = seen.join(seen.select(first, turn, (F.col(line) + 1).alias(line), F.col("_state").alias("_before")),
                      [first, turn, line]).groupBy("_before", "_state").count()
    outer = seen.filter(F.col(line) == 0).join(
        ends.select(first, (F.col(turn) + 1).alias(turn), "_before"), [first, turn]).groupBy("_before", "_state").count()
    move = np.ones((states, states))
    for a, b, n in [*inner.collect(), *outer.collect()]:
        move[a, b] += n
    start = np.ones(states)
    opening = seen.groupBy(first).agg(F.min(F.struct(turn, line, "_state")).alias("_first"))
    for s, n in opening.groupBy("_first._state").count().collect():
        start[s] += n
    return Model(roles, np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), emit)


def _emissions(table: pa.Table, model: Model) -> np.ndarray:
    """(lines, states): log score of what each line shows."""
    total = np.zeros((table.num_rows, model.states))
    for f in FEATURES:
        total += model.emit[f][:, table.column(f).to_numpy()].T
    return total


def _pieces(table: pa.Table) -> list[tuple[int, int]]:
    """(first, end) of each transcript in the sorted lines of a slice."""
    conv = table.column("_conv").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(conv)) + 1).tolist(), len(conv)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def best_matrix(emissions: np.ndarray, move: np.ndarray) -> np.ndarray:
    """[i, j]: the best score of the lines ending in state j, after state i before them."""
    best = move + emissions[0]
    for e in emissions[1:]:
        best = (best[:, :, None] + move[None]).max(axis=1) + e
    return best


def decode(emissions: np.ndarray, first: np.ndarray, move: np.ndarray, last: int | None) -> np.ndarray:
    """The best states of some lines; ``first`` are the scores of entering each state."""
    score, back = first + emissions[0], []
    for e in emissions[1:]:
        ways = score[:, None] + move
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    states = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return np.array(states[::-1])


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in _SORT])


def parse(lines: DataFrame, model: Model, text_col: str = "text",
          order_cols: tuple[str, ...] = ("conv_id", "turn", "line"), slice_lines: int = SLICE_LINES) -> DataFrame:
    """(order_cols, role_pred, begins_pred, rendered) of every line.

    ``rendered`` holds the line, after the canonical header where a turn begins and before the
    closing mark where the transcript ends: in order, the lines of a transcript are its canonical
    form. Of the line itself only the marker of a known speaker goes, and only where a turn begins;
    other names before a colon, indentation and all else stay.
    """
    spark, (conv, turn, line) = lines.sparkSession, order_cols
    kind = {c: lines.schema[c].dataType.simpleString() for c in order_cols}
    seen = observe(lines, text_col).select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(line).alias("_line"),
        text_or_empty(text_col).alias("_text"), without_marker(text_or_empty(text_col)).alias("_plain"), *FEATURES)
    parts = max(1, -(-lines.count() // slice_lines))
    sliced = stored(seen.repartitionByRange(parts, *_SORT).withColumn("_slice", F.spark_partition_id()))
    shared = spark.sparkContext.broadcast(model)  # a few states and features

    def summarise(group: pa.Table) -> pa.Table:
        group, rows = _sorted(group), []
        pieces = _pieces(group)
        emissions = _emissions(group, shared.value)
        for a, b in {pieces[0], pieces[-1]}:
            e = emissions[a:b]
            rows.append((a, best_matrix(e, shared.value.move).ravel().tolist(),
                         best_first(e, shared.value).tolist()))
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.Table.from_arrays(
            [group.column("_slice").take(at), group.column("_conv").take(at), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
             pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["_slice", "_conv", "matrix", "begin"])

    def best_first(e: np.ndarray, m: Model) -> np.ndarray:
        score = m.start + e[0]
        for x in e[1:]:
            score = (score[:, None] + m.move).max(axis=0) + x
        return score

    def chain(group: pa.Table) -> pa.Table:
        """States at the end of each slice of one transcript; one row per slice it touches."""
        group = group.sort_by("_slice")
        slices, n = group.column("_slice").to_pylist(), shared.value.states
        score, back = np.array(group.column("begin")[0].as_py()), []
        for m in group.column("matrix").to_pylist()[1:]:
            ways = score[:, None] + np.array(m).reshape(n, n)
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        states = [int(score.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states = states[::-1]
        return pa.Table.from_arrays(
            [pa.array(slices, pa.int32()), group.column("_conv").combine_chunks(), pa.array([None, *states[:-1]], pa.int32()),
             pa.array(states, pa.int32()), pa.array([False] * (len(states) - 1) + [True])],
            names=["_slice", "_conv", "before", "end", "closes"])

    cuts = sliced.groupBy("_slice").applyInArrow(
        summarise, f"_slice int, _conv {kind[conv]}, matrix array<double>, begin array<double>")
    bounds = stored(cuts.groupBy("_conv").applyInArrow(
        chain, f"_slice int, _conv {kind[conv]}, before int, end int, closes boolean"))

    def settle(group: pa.Table, bounds: pa.Table) -> pa.Table:
        group, m = _sorted(group), shared.value
        known = {r["_conv"]: r for r in bounds.to_pylist()}
        emissions, states = _emissions(group, m), np.empty(group.num_rows, np.int64)
        closing = np.zeros(group.num_rows, bool)
        names = group.column("_conv")
        for a, b in _pieces(group):
            at = known.get(names[a].as_py())
            first = m.start if at is None or at["before"] is None else m.move[at["before"]]
            states[a:b] = decode(emissions[a:b], first, m.move, None if at is None else at["end"])
            closing[b - 1] = at is None or at["closes"]
        begins = states >= len(m.roles)
        spoken = begins & (group.column("marker").to_numpy() > KINDS.index("other"))
        roles = np.array(m.roles, object)[states % len(m.roles)]
        return pa.Table.from_arrays(
            [*[group.column(c).combine_chunks() for c in ("_conv", "_turn", "_line")], pa.array(roles, pa.string()),
             pa.array(begins), pa.array(closing), pc.if_else(pa.array(spoken), *[group.column(c).combine_chunks()
                                                                               for c in ("_plain", "_text")])],
            names=[*order_cols, "role_pred", "begins_pred", "_closes", "_plain"])

    keys = ", ".join(f"`{c}` {kind[c]}" for c in order_cols)
    settled = sliced.groupBy("_slice").cogroup(bounds.groupBy("_slice")).applyInArrow(
        settle, f"{keys}, role_pred string, begins_pred boolean, _closes boolean, _plain string")
    header = F.when(F.col("begins_pred"), F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"))).otherwise(F.lit(""))
    footer = F.when(F.col("_closes"), F.lit("\n<|end|>")).otherwise(F.lit(""))
    return settled.select(*order_cols, "role_pred", "begins_pred", F.concat(header, "_plain", footer).alias("rendered"))
