"""Repair of damaged conversations by a run-length dynamic programme.

A conversation is a row of symbols: a role's initial and a fault. Equal consecutive symbols
are one run. The legal role sequences ``(s?(ua)+)?`` have four states, so a row's cheapest
effect is a 4 x 4 min-plus matrix, with insertions before the row included; a run of any
length is crossed by the cached binary powers of its matrix. Costs to go are found from the
end, then the edits are read off from the start. A state and an edit name the next state
alone, so the first letter in ASCII order among those that stay cheapest gives the least
audit.

Equal rows are counted together first, and the rows are range-partitioned along (conversation,
turn, role, text), so a conversation may cross partitions, and no task holds more than a slice of
one. Conversations inside one slice are settled there. Of the others, each slice sends its matrix;
from them its cost to go and, after a second pass, its first state are known. Repaired texts are
hashed as a stream in order.

Edits: keep (0), rerole to user or assistant (2), delete (3; blank rows and repeats must go),
insert an empty turn of user or assistant anywhere (2). A truncated row that stays adds 1.

Defined results: rows are taken by turn, null first, then by role and text in byte order. A
null role or text counts as one space. Null is a conversation id like any other. A
conversation whose rows all have ``times`` 0 has zeros, an empty audit and no turns. Of rows
equal in role and text the first stays fit, the others are repeats. An empty table gives an
empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionloom.llm.common import SPACES
from actionloom.session import stored

#: A slice ends after so many distinct rows or so many bytes of text.
SLICE_ROWS, SLICE_BYTES = 16384, 4 << 20
#: Runs from this length on are crossed by powers.
SHORT_RUN = 8
ROLES = {"u": "user", "a": "assistant"}
SENTENCE_ENDS = ".!?"
DELETE, INSERT, KEEP, REROLE = "DIKR"
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the only state that a new user or assistant turn can lead to
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60
#: Costs to go after the last row: the turns that have to be inserted still.
ACCEPT = (0, 2 * INSERT_COST, INSERT_COST, 0)
FINE, BLANK, TRUNCATED = range(3)
GONE = ("", BLANK)  # the symbol of rows that have to be deleted


class Step(NamedTuple):
    """The cheapest ways over one row: costs to go before it, less ``base``, and per state the
    letters written and the state after the row."""

    base: int
    costs: tuple[int, ...]
    ways: tuple[tuple[str, int], ...]


def _moves(symbol: tuple[str, int], state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that use up a row, in order of the letters."""
    found = [(DELETE, DELETE_COST, state)]
    if symbol != GONE:
        initial, fault = symbol
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        kept = _KEPT.get(initial, {}).get(state)
        if kept is not None:
            found.append((KEEP, extra, kept))
        found.append((REROLE, REROLE_COST + extra, _NEXT[state]))
    return found


@lru_cache(maxsize=None)  # seven symbols that are legal in some place, and two for all other roles
def _row_matrix(symbol: tuple[str, int]) -> np.ndarray:
    matrix = np.full((4, 4), _FAR, np.int64)
    for first in range(4):
        state, paid = first, 0
        for _ in range(3):  # more than two insertions come back to where one began
            for _, cost, after in _moves(symbol, state):
                matrix[first, after] = min(matrix[first, after], paid + cost)
            state, paid = _NEXT[state], paid + INSERT_COST
    return matrix


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _FAR)


@lru_cache(maxsize=None)  # 64 powers at most of each symbol
def _power(symbol: tuple[str, int], k: int) -> np.ndarray:
    """The effect of 2**k equal rows."""
    return _row_matrix(symbol) if k == 0 else times(_power(symbol, k - 1), _power(symbol, k - 1))


def run_matrix(symbol: tuple[str, int], length: int) -> np.ndarray:
    matrix = None
    for k in range(length.bit_length()):
        if length >> k & 1:
            matrix = _power(symbol, k) if matrix is None else times(matrix, _power(symbol, k))
    return matrix


@lru_cache(maxsize=4096)
def step(symbol: tuple[str, int], after: tuple[int, ...]) -> Step:
    """The step over one row; ``after`` are costs to go whose least is 0."""
    costs = (_row_matrix(symbol) + np.array(after, np.int64)).min(axis=1).tolist()
    ways = []
    for first in range(4):
        state, letters = first, ""
        while True:
            options = [(letter, to) for letter, cost, to in _moves(symbol, state) if cost + after[to] == costs[state]]
            if costs[_NEXT[state]] + INSERT_COST == costs[state]:
                options.append((INSERT, _NEXT[state]))
            letter, state = min(options)
            letters += letter
            if letter != INSERT:
                break
        ways.append((letters, state))
    base = min(costs)
    return Step(base, tuple(c - base for c in costs), tuple(ways))


def runs_of(symbols: list[tuple[tuple[str, int], int]]) -> list[tuple[tuple[str, int], int]]:
    """Equal neighbours joined."""
    runs: list[tuple[tuple[str, int], int]] = []
    for symbol, n in symbols:
        if runs and runs[-1][0] == symbol:
            runs[-1] = (symbol, runs[-1][1] + n)
        elif n:
            runs.append((symbol, n))
    return runs


def _before(symbol: tuple[str, int], length: int, base: int, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs to go before a run, as their least and what each state has above it."""
    if symbol == GONE:  # inserting can wait, so every row is deleted in the state one is in
        return base + DELETE_COST * length, costs
    if length < SHORT_RUN:
        for _ in range(length):
            crossed = step(symbol, costs)
            base, costs = base + crossed.base, crossed.costs
        return base, costs
    vector = np.array(costs, np.int64)
    for k in range(length.bit_length()):
        if length >> k & 1:
            vector = (_power(symbol, k) + vector).min(axis=1)
    low = int(vector.min())
    return base + low, tuple((vector - low).tolist())


class Unrolled(NamedTuple):
    """Letters written for each run and after the last; cost to go at the start; state at the end."""

    letters: list[str]
    cost: int
    state: int


def unroll(runs: list[tuple[tuple[str, int], int]], after: tuple[int, ...], state: int, closes: bool) -> Unrolled:
    """The least audit among the cheapest; with ``closes``, turns missing at the end are inserted."""
    low = min(after)
    ends = [(low, tuple(c - low for c in after))]
    for symbol, n in reversed(runs):
        ends.append(_before(symbol, n, *ends[-1]))
    cost = ends[-1][0] + ends[-1][1][state]
    letters = []
    for (symbol, n), (_, costs) in zip(runs, reversed(ends[:-1])):
        if symbol == GONE:
            letters.append(DELETE * n)
            continue
        steps = []
        for _ in range(n):
            steps.append(step(symbol, costs))
            costs = steps[-1].costs
        written = []
        for s in reversed(steps):
            one, state = s.ways[state]
            written.append(one)
        letters.append("".join(written))
    last = ""
    while closes and ACCEPT[state]:
        last, state = last + INSERT, _NEXT[state]
    return Unrolled([*letters, last], cost, state)


def _turns(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits; the rows are those that need not go, in order."""
    out_roles, out_texts, at = [], [], 0
    for letter in audit:
        if letter == KEEP:
            out_roles.append(roles[at])
            state = _KEPT[roles[at][:1]][state]
        elif letter != DELETE:
            state = _NEXT[state]
            out_roles.append(_ROLE_OF[state])
        if letter in (KEEP, REROLE):
            out_texts.append(texts[at])
        elif letter == INSERT:
            out_texts.append("")
        at += letter in (KEEP, REROLE, DELETE)
    return out_roles, out_texts


def _runs(row: dict) -> list[tuple[tuple[str, int], int]]:
    return [((i, f), n) for i, f, n in zip(row["initials"], row["faults"], row["lengths"])]


def _edit(row: dict, after: tuple[int, ...], state: int, closes: bool) -> dict:
    """The audit of a slice and its turns after the edits."""
    runs = _runs(row)
    found = unroll(runs, after, state, closes)
    # ``roles`` and ``texts`` hold no row that has to go.
    walked = [w for (symbol, _), w in zip(runs, found.letters) if symbol != GONE]
    roles, texts = _turns("".join([*walked, found.letters[-1]]), state, row["roles"], row["texts"])
    return {**row, "audit": "".join(found.letters), "cost": found.cost, "roles": roles, "texts": texts}


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SLICE = (
    "part int, slice int, settled boolean, initials array<string>, faults array<int>, lengths array<long>, "
    "matrix array<long>, roles array<string>, texts array<string>, audit string, cost long, "
    "blank long, duplicate long, truncated long, illegal long, turns long, least_turn {turn}, most_turn {turn}, "
    "first_initial string, last_initial string")


def _summary(rows: list[tuple]) -> dict:
    """A slice of sorted rows (turn, role, text, times, fault, first)."""
    symbols, roles, texts, counts = [], [], [], dict.fromkeys(_COUNTS, 0)
    before = first_initial = least = most = None
    for turn, role, text, n, fault, first in rows:
        if not n:  # a dropped row: only its conversation counts
            continue
        initial = role[:1]
        first_initial = initial if before is None else first_initial
        counts["illegal"] += n - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
        before = initial
        if turn is not None:
            least = turn if least is None else least
            counts["turns"] += turn != most
            most = turn
        if fault == BLANK:
            counts["blank"] += n
            symbols.append((GONE, n))
            continue
        counts["duplicate"] += n - first
        if first:
            counts["truncated"] += fault == TRUNCATED
            symbols.append(((initial if initial in _KEPT else "", fault), 1))
            roles.append(role)
            texts.append(text)
        symbols.append((GONE, n - first))
    runs = runs_of(symbols)
    return {"initials": [s[0] for s, _ in runs], "faults": [s[1] for s, _ in runs], "lengths": [n for _, n in runs],
            "roles": roles, "texts": texts, "least_turn": least, "most_turn": most,
            "first_initial": first_initial, "last_initial": before, **counts}


def _product(row: dict) -> list[int]:
    matrix = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for symbol, n in _runs(row):
        matrix = times(matrix, run_matrix(symbol, n))
    return matrix.ravel().tolist()


def _cut(names: list[str]):
    """Slices from the sorted rows of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, opening = TaskContext.get().partitionId(), 0, True
        held: list[tuple] = []  # rows of the conversation being read
        ids, size, split = None, 0, False

        def flush(ended: bool) -> tuple:
            nonlocal held, size, made, split, opening
            row = _summary(held)
            settled = ended and not split and not opening
            row |= {"part": part, "slice": made, "settled": settled, "matrix": None, "audit": None, "cost": None}
            if settled:
                row = _edit(row, ACCEPT, START, True) | {"initials": None, "faults": None, "lengths": None}
            else:
                row["matrix"] = _product(row)
            held, size, made, split = [], 0, made + 1, not ended
            opening = opening and not ended
            return ids, row

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field(names[0], batch.schema.field(0).type), *_arrow(batch.schema.field(1).type)])
            ready = []
            conv = batch.column(0)
            codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for a, b in zip(cuts, cuts[1:]):
                this = conv.slice(a, 1)
                if ids is not None and not this.equals(ids):
                    ready.append(flush(True))
                ids = this
                for row in zip(*(c[a:b] for c in columns)):
                    held.append(row)
                    size += len(row[2])
                    if len(held) >= SLICE_ROWS or size >= SLICE_BYTES:
                        ready.append(flush(False))
            yield from _table(ready, schema)
        if ids is not None:  # its conversation may go on in the next partition
            yield from _table([flush(False)], schema)

    return run


def _arrow(turn: pa.DataType) -> list[pa.Field]:
    words, numbers = pa.list_(pa.string()), pa.list_(pa.int64())
    kinds = {"part": pa.int32(), "slice": pa.int32(), "settled": pa.bool_(), "initials": words,
             "faults": pa.list_(pa.int32()), "lengths": numbers, "matrix": numbers, "roles": words, "texts": words,
             "audit": pa.string(), "cost": pa.int64(), **dict.fromkeys(_COUNTS, pa.int64()), "least_turn": turn,
             "most_turn": turn, "first_initial": pa.string(), "last_initial": pa.string()}
    return [pa.field(k, v) for k, v in kinds.items()]


def _table(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        ids = pa.concat_arrays([r[0] for r in rows])
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array([r[1][f.name] for r in rows], f.type) for f in list(schema)[1:])], schema=schema)


def _suffixes(group: pa.Table) -> pa.Table:
    """Costs to go after each slice of one split conversation."""
    group = group.sort_by([("part", "ascending"), ("slice", "ascending")])
    after = [ACCEPT]
    for m in reversed(group.column("matrix").to_pylist()[1:]):
        after.append(tuple((np.array(m).reshape(4, 4) + np.array(after[-1])).min(axis=1).tolist()))
    after, n = after[::-1], group.num_rows
    return pa.Table.from_arrays(
        [*[group.column(c).combine_chunks() for c in ("part", "slice")], pa.array(after, pa.list_(pa.int64())),
         pa.array([i == 0 for i in range(n)]), pa.array([i == n - 1 for i in range(n)])],
        names=["part", "slice", "after", "opens", "closes"])


def _choose(group: pa.Table) -> pa.Table:
    """The first state of each slice of one split conversation."""
    group = group.sort_by([("part", "ascending"), ("slice", "ascending")])
    states = [START]
    for ends in group.column("ends").to_pylist()[:-1]:
        states.append(ends[states[-1]])
    return pa.Table.from_arrays(
        [*[group.column(c).combine_chunks() for c in ("part", "slice")], pa.array(states, pa.int32())],
        names=["part", "slice", "state"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each first state of a slice, the last one."""
    for batch in batches:
        ends = []
        for row in batch.to_pylist():
            firsts = [START] if row["opens"] else range(4)
            ends.append([unroll(_runs(row), tuple(row["after"]), s, False).state for s in firsts])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv", "part", "slice")], pa.array(ends, pa.list_(pa.int32()))],
            names=["conv", "part", "slice", "ends"])


def _settle(names: list[str]):
    """Slices of split conversations with their edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):  # a slice is up to 4 MB
                edited = _edit(row, tuple(row["after"]), row["state"], row["closes"])
                edited |= {"initials": None, "faults": None, "lengths": None, "matrix": None,
                           "cost": edited["cost"] if row["opens"] else 0}
                kept = batch.schema.field
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(at, 1) if n == names[0] else pa.array([edited[n]], kept(n).type)
                     for n in names], schema=pa.schema([kept(n) for n in names]))

    return run


def fault(text_col: str = "text") -> Column:
    """0 for a fit text, 1 for one without a visible character, 2 for one cut before its end."""
    bare = F.rtrim(F.col(text_col), F.lit(SPACES))
    return (F.when(F.length(bare) == 0, BLANK).when(F.right(bare, F.lit(1)).isin(*SENTENCE_ENDS), FINE)
            .otherwise(TRUNCATED))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", times_col: str | None = None) -> DataFrame:
    """Edited slices: (conv, part, slice, settled, audit, cost, roles, texts, counts, ends).

    ``times_col`` says how often a row stands there; 0 only names its conversation. A settled
    slice is a whole conversation. The slices of another one follow (part, slice); costs and
    counts add up along them, as ``digest`` does. ``roles`` and ``texts`` are the repaired turns.
    """
    times = F.col(times_col).cast("long") if times_col else F.lit(1).cast("long")
    plain = lambda c: F.when(times > 0, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise(F.lit(""))
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.when(times > 0, F.col(turn_col)).alias("turn"), plain(role_col).alias("role"),
        plain(text_col).alias("text"), times.alias("n"))
    # Equal rows become one before anything is moved, however many they are.
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    name = F.to_json(F.struct(F.col("conv").cast("string").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")))
    keyed = counted.withColumn("key", F.sha2(name, 256))
    firsts = keyed.filter("n > 0").groupBy("key").agg(F.min(F.struct("turn")).alias("earliest"))  # null is least
    marked = keyed.join(firsts, "key", "left").select(
        "conv", "turn", "role", "text", "n", fault("text").alias("fault"),
        F.coalesce(F.col("turn").eqNullSafe(F.col("earliest.turn")) & (F.col("n") > 0), F.lit(False)).alias("first"))
    order = ("conv", "turn", "role", "text")
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = {c: marked.schema[c].dataType for c in ("conv", "turn")}
    schema = T.StructType([T.StructField("conv", kind["conv"]),
                           *T.StructType.fromDDL(_SLICE.format(turn=kind["turn"].simpleString())).fields])
    names = schema.fieldNames()
    slices = stored(ranged.mapInArrow(_cut(names), schema))

    split = slices.filter("NOT settled")
    after = stored(split.select("conv", "part", "slice", "matrix").groupBy("conv").applyInArrow(
        _suffixes, "part int, slice int, after array<long>, opens boolean, closes boolean"))
    known = split.join(after, ["part", "slice"])
    ends = T.StructType([schema["conv"], schema["part"], schema["slice"], T.StructField("ends", T.ArrayType(T.IntegerType()))])
    state = known.select("conv", "part", "slice", "initials", "faults", "lengths", "after", "opens").mapInArrow(
        _ends, ends).groupBy("conv").applyInArrow(_choose, "part int, slice int, state int")
    mended = known.join(state, ["part", "slice"]).mapInArrow(_settle(names), schema)
    done = stored(mended)
    return slices.filter("settled").unionByName(done).drop("initials", "faults", "lengths", "matrix")


def repaired_turns(edited: DataFrame) -> DataFrame:
    """(conv, part, slice, place, role, text): the turns after the repair; the order is that of the last three numbers."""
    return edited.select("conv", "part", "slice", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select(
        "conv", "part", "slice", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def _whole(names: list[str]):
    """One row per split conversation from its slices in order, read as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = digest = None

        def close() -> pa.RecordBatch:
            row = held | {"audit": "".join(held["audits"]), "repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_arrays(
                [row["conv"] if n == "conv" else pa.array([row[n]], kinds[n]) for n in names], names=names)

        for batch in batches:
            schema = batch.schema
            kinds = {n: schema.field(n).type if n in schema.names else pa.string() for n in names}
            for at, row in enumerate(batch.to_pylist()):
                conv = batch.column("conv").slice(at, 1)
                if held is None or not conv.equals(held["conv"]):
                    if held is not None:
                        yield close()
                    held, digest, written = row | {"conv": conv, "audits": []}, hashlib.sha256(), False
                else:
                    for n in (*_COUNTS, "cost"):
                        held[n] += row[n]
                    if held["last_initial"] is not None and row["first_initial"] is not None:
                        held["illegal"] += held["last_initial"] + row["first_initial"] not in ("su", "ua", "au")
                    held["turns"] -= held["most_turn"] is not None and held["most_turn"] == row["least_turn"]
                    held["least_turn"] = row["least_turn"] if held["least_turn"] is None else held["least_turn"]
                    held["most_turn"] = held["most_turn"] if row["most_turn"] is None else row["most_turn"]
                    held["last_initial"] = held["last_initial"] if row["last_initial"] is None else row["last_initial"]
                held["audits"].append(row["audit"])
                for role, text in zip(row["roles"], row["texts"]):
                    digest.update((("\n" if written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    written = True
        if held is not None:
            yield close()

    return run


def digest(edited: DataFrame) -> DataFrame:
    """One row per conversation: its counts, cost, audit and the hash of the repaired text.

    The hash of a text is sequential by definition, so the slices of one split conversation
    pass through one task; they do so as a stream, one slice in memory at a time.
    """
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    wanted = ["conv", "least_turn", "most_turn", *_COUNTS, "cost", "audit", "repaired_sha256"]
    whole = edited.filter("settled").withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n").cast("binary"), 256))
    split = edited.filter("NOT settled")
    schema = T.StructType([edited.schema[n] if n in edited.columns else T.StructField(n, T.StringType()) for n in wanted])
    parts = int(edited.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = split.repartition(parts, "conv").sortWithinPartitions("conv", "part", "slice").mapInArrow(_whole(wanted), schema)
    return whole.select(*wanted).unionByName(joined).select(
        "conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
