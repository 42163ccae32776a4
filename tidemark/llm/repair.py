"""Repair of conversations whose turns are missing, blank, repeated, cut off or of the wrong role.

A repaired conversation's roles read ``(s?(ua)+)?`` by initials. Its rows can be kept
(0), given the role user or assistant (2) or deleted (3, a must for blank and repeated rows), and empty turns
of user or assistant be inserted (2 each); a row cut off that stays costs 1 more. The cheapest
edits are found, of equally cheap ones the least string of their initials D, I, K and R.

Rows become symbols of role and fault; equal neighbours are runs. What a row does to
the cost of ending well, from each of four states of the pattern, is a
min-plus matrix; a run advances by the cached binary powers of its symbol's matrix.
Costs are found backwards, and the choices then unrolled forwards, block of a power of two by
block: a block's choices depend on its symbol, its state and the costs after it
only, and so are remembered too.

Rows are range-partitioned and sorted by conversation and turn, and packed to chunks of up to
``CHUNK`` symbols, so that a conversation of any length is many tasks' work. Where one has several
chunks, these are brought to a matrix each, and the states that they begin and end
in are chained from these. Texts don't take part until the choices are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Symbols of a chunk at most.
CHUNK = 1 << 16
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Initials of roles, by number; any other has OTHER.
INITIALS, OTHER = "sua", 3
#: Faults, by number.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
FAULTS = 4
#: States: nothing yet, after the system's turn, after a user's, after an assistant's. The first and last may end.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: State after a turn of s, u or a; absent where the pattern has no such turn.
NEXT = {(NOTHING, 0): SYSTEM, **{(q, 1): USER for q in (NOTHING, SYSTEM, ASSISTANT)}, (USER, 2): ASSISTANT}
#: Of an inserted or renamed turn there is one kind in each state: its initial's number.
OWED = {NOTHING: 1, SYSTEM: 1, USER: 2, ASSISTANT: 1}
#: Pairs of neighbouring initials that are legal, by number.
LEGAL = ("01", "12", "21")
FAR = 1 << 40
#: Blocks up to 2 ** CACHED rows are remembered.
CACHED = 8

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)) for row in a)


def applied(a: Matrix, v: Vector) -> Vector:
    v0, v1, v2, v3 = v
    return tuple([min(r[0] + v0, r[1] + v1, r[2] + v2, r[3] + v3) for r in a])


def level(v: Vector) -> Vector:
    """Costs above the least of them: choices depend on nothing else."""
    least = min(v)
    return tuple([x - least for x in v]) if least else v


def _inserts() -> Matrix:
    """Cost of getting from state to state by inserted turns."""
    once = tuple(tuple(0 if q == p else INSERT if NEXT[q, OWED[q]] == p else FAR for p in STATES) for q in STATES)
    return product(product(once, once), product(once, once))


INSERTS = _inserts()
END = applied(INSERTS, (0, FAR, FAR, 0))
NEUTRAL: Matrix = tuple(tuple(0 if p == q else FAR for p in STATES) for q in STATES)


@lru_cache(None)
def choices(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """What can be done with a row: letter, cost and next state. K keeps, U and A rename, D deletes."""
    initial, fault = divmod(symbol, FAULTS)
    made = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        extra = CUT_OFF * (fault == TRUNCATED)
        if (state, initial) in NEXT:
            made.append(("K", extra, NEXT[state, initial]))
        made.append((" UA"[OWED[state]], RENAME + extra, NEXT[state, OWED[state]]))
    return tuple(made)


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """Matrix of 2 ** k rows of a symbol, each with the inserts before it."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    one = [[FAR] * 4 for _ in STATES]
    for q in STATES:
        for _, cost, p in choices(symbol, q):
            one[q][p] = min(one[q][p], cost)
    return product(INSERTS, tuple(map(tuple, one)))


def _row(symbol: int, state: int, v: Vector) -> tuple[str, int]:
    """The least of the cheapest edits up to and with one row, and the state after it. u and a insert."""
    out, best = "", applied(power(symbol, 0), v)
    while True:
        done = {letter: p for letter, cost, p in choices(symbol, state) if cost + v[p] == best[state]}
        after = NEXT[state, OWED[state]]
        if "D" not in done and INSERT + best[after] == best[state]:
            out, state = out + " ua"[OWED[state]], after
            continue
        letter = next(x for x in "DKUA" if x in done)
        return out + letter, done[letter]


@lru_cache(1 << 18)
def _remembered(symbol: int, k: int, state: int, v: Vector) -> tuple[str, int]:
    return _unrolled(symbol, k, state, v)


def _unrolled(symbol: int, k: int, state: int, v: Vector) -> tuple[str, int]:
    """Edits of 2 ** k rows of a symbol from a state on, where v has the (level) costs after them, and the state then."""
    if not k:
        return _row(symbol, state, v)
    half = _remembered if k <= CACHED else _unrolled
    one, state = half(symbol, k - 1, state, level(applied(power(symbol, k - 1), v)))
    two, state = half(symbol, k - 1, state, v)
    return one + two, state


def runs(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Symbols and lengths of runs."""
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    starts = np.concatenate([[0], cuts, [len(symbols)]])
    return list(zip(symbols[starts[:-1]].tolist(), np.diff(starts).tolist(), strict=True))


def matrix(symbols: np.ndarray) -> Matrix:
    out = NEUTRAL
    for symbol, n in runs(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = product(out, power(symbol, k))
    return out


def edits(symbols: np.ndarray, state: int = NOTHING, v: Vector = END) -> tuple[str, int, int]:
    """The edits' letters, the state after them and their cost up to v's."""
    blocks, cost, v = [], min(v), level(v)
    for symbol, n in reversed(runs(symbols)):
        for k in range(n.bit_length()):
            if n >> k & 1:
                blocks.append((symbol, k, v))
                moved = applied(power(symbol, k), v)
                v = level(moved)
                cost += min(moved)
    total = cost + v[state]
    out = []
    for symbol, k, after in reversed(blocks):
        piece, state = (_remembered if k <= CACHED else _unrolled)(symbol, k, state, after)
        out.append(piece)
    return "".join(out), state, total


def closing(state: int) -> str:
    """Inserts after the last row."""
    return {SYSTEM: "ua", USER: "a"}.get(state, "")


class Repair(NamedTuple):
    """``counts``: a row per conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``turns``: its rows in the order of ``place``: conv_id, place (a struct), turn, role and text as found,
    and ``edit``, the letters of what is done before and with the row: K (kept), U and A (made user and assistant), D (deleted), u and a (empty turn of user or assistant inserted).
    """

    counts: DataFrame
    turns: DataFrame


def repair(turns: DataFrame) -> Repair:
    """Repair of ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored.

    Null roles and texts count as one space. Turns are in the order of ``turn``, nulls first, ties by
    a digest of role and text. Rows whose conv_id is null are a conversation of their own. An empty table gives no rows; ``gaps`` beyond 64 bits is null.
    """
    blank = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.select("*", F.monotonically_increasing_id().alias("row"), F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text").cast("binary"), 256).alias("digest"))
    rows = stored(rows)
    chunks = stored(packed(_marked(rows)))
    told = stored(edited(chunks))
    # one piece per row: the letters up to and with its own
    pieces = told.select("chunk", "tail", F.size("rows").alias("n"), F.posexplode(F.arrays_zip(F.col("rows").alias("row"), F.split("letters", "(?<=[KUAD])(?=.)").alias("edit"))).alias("at", "own"))
    tail = F.when(F.col("at") + 1 == F.col("n"), F.col("tail")).otherwise("")
    found = pieces.select("own.row", F.struct("chunk", "at").alias("place"), F.concat("own.edit", tail).alias("edit"))
    made = rows.hint("merge").join(found, "row").select("conv_id", "place", "turn", "role", "text", "edit")
    return Repair(_counts(rows, told), made)


def repaired(turns: DataFrame) -> DataFrame:
    """The conversations as mended, from ``Repair.turns``: conv_id, place, at (inserted turns have the place of the row they stand before or after), role and text."""
    letters = F.filter(F.split("edit", ""), lambda x: (x != "") & (x != "D"))
    rows = turns.select("conv_id", "place", "role", "text", F.posexplode(letters).alias("at", "letter"))
    role = F.when(F.col("letter") == "K", F.col("role")).when(F.lower("letter") == "u", "user").otherwise("assistant")
    return rows.select("conv_id", "place", "at", role.alias("role"), F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def digests(mended: DataFrame) -> DataFrame:
    """conv_id and the hash of its ``role:text`` lines, from ``repaired``. A hash is made from front to end, so a conversation is one task's stream; it is read in sorted order and never held."""
    kind = mended.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, out = batch.column(0).to_pylist(), []
            for c, line in zip(ids, batch.column(1), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_buffer())
            conv_type = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], conv_type), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    lines = mended.select("conv_id", "place", "at", F.concat_ws(":", "role", "text").cast("binary").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "at").select("conv_id", "line")
    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def with_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on conv_id, null included."""
    other = right.withColumnRenamed("conv_id", "__conv")
    return left.join(other, left["conv_id"].eqNullSafe(other["__conv"]), "left").drop("__conv")


def _counts(rows: DataFrame, told: DataFrame) -> DataFrame:
    wide = lambda x: x.cast("decimal(20,0)")
    turn = F.col("turn")
    span = rows.groupBy("conv_id").agg(F.coalesce(wide(F.max(turn)) - wide(F.min(turn)) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))
    audit = F.translate(F.concat("letters", "tail"), "uaUA", "IIRR")
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    every = told.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in names], F.sort_array(F.collect_list(F.struct("chunk", audit.alias("audit"), "first_initial", "last_initial"))).alias("chunks"))
    n = F.size("chunks") - 1  # of neighbouring chunks, whose rows meet too
    legal = lambda a, b: F.concat(a["last_initial"].cast("string"), b["first_initial"].cast("string")).isin(*LEGAL)
    between = F.zip_with(F.slice("chunks", F.lit(1), n), F.slice("chunks", F.lit(2), n), lambda a, b: F.when(legal(a, b), 0).otherwise(1))
    met = F.aggregate(between, F.lit(0), lambda x, y: x + y)
    every = every.withColumn("illegal", F.col("illegal") + met).withColumn("audit", F.array_join(F.col("chunks.audit"), ""))
    return with_conversation(every, span.withColumn("gaps", F.col("gaps").try_cast("long"))).select("conv_id", "gaps", *names, "audit")


def _marked(rows: DataFrame) -> DataFrame:
    """A symbol per row, and what it is sorted by. The first of equal rows of a conversation is found by an aggregate and told to that row by its number, so that no group's rows meet."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    first = rows.groupBy("conv_id", "digest").agg(F.min(order)["row"].alias("row")).select("row", F.lit(True).alias("first"))
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    light = rows.select("conv_id", "turn", "digest", "row", F.substring("role", 1, 1).alias("initial"), end.alias("last"))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(INITIALS) for x in (c, i)]), "initial"), F.lit(OTHER))
    return light.hint("merge").join(first, "row", "left").select("conv_id", "turn", "digest", "row", (initial * FAULTS + fault).cast("int").alias("symbol"))


def packed(marked: DataFrame) -> DataFrame:
    """Chunks of a conversation in order: conv_id, chunk (ascending), rows (their numbers) and symbols."""
    kind = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        open_conv, size = None, 0

        def batch_of(pieces: list) -> pa.RecordBatch:
            conv, ids, rows, symbols = zip(*pieces, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(conv, conv_type), pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(symbols, pa.binary())], names=["conv_id", "chunk", "rows", "symbols"])

        def closed() -> tuple:
            nonlocal made, size
            out = (open_conv, part << 32 | made, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]).tobytes())
            held.clear()
            made, size = made + 1, 0
            return out

        done, weight = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv_type = batch.column(0).type
            ids = batch.column(0).to_pylist()
            rows, symbols = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint8)
            at = 0
            for end in [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)]:
                if held and ids[at] != open_conv:
                    done.append(closed())
                open_conv = ids[at]
                while at < end:
                    step = min(end - at, CHUNK - size)
                    held.append((rows[at : at + step], symbols[at : at + step]))
                    at, size, weight = at + step, size + step, weight + step
                    if size == CHUNK:
                        done.append(closed())
            if done and weight > CHUNK:
                yield batch_of(done)
                done, weight = [], 0
        if held:
            done.append(closed())
        if done:
            yield batch_of(done)

    key = ["conv_id", "turn", "digest", "row"]
    ordered = marked.repartitionByRange(*key).sortWithinPartitions(*key)
    return ordered.select("conv_id", "row", "symbol").mapInArrow(run, f"conv_id {kind}, chunk long, rows array<long>, symbols binary")


def _symbols(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


def edited(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, rows, letters (of the chunk's edits), tail (inserts after a conversation's last row), cost (of the conversation, in its first chunk), and counts of faults and of neighbours that aren't legal, with the chunk's first and last initial."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    heads = stored(chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("several")))
    same = F.col("conv_id").eqNullSafe(F.col("several"))
    alone = chunks.join(heads, same, "left_anti").select("conv_id", "chunk", "rows", "symbols", F.lit(NOTHING).alias("state"), F.array(*map(F.lit, END)).cast("array<long>").alias("after"), F.lit(True).alias("first"), F.lit(True).alias("last"))
    if not heads.isEmpty():
        alone = alone.unionByName(_chained(stored(chunks.join(heads, same, "left_semi"))))
    kept, made = ("conv_id", "chunk", "rows"), ("letters", "tail", "cost", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, state, after, first, last in zip(*[batch.column(c) for c in ("symbols", "state", "after", "first", "last")], strict=True):
                symbols = _symbols(value)
                letters, end, cost = edits(symbols, state.as_py(), tuple(after.as_py()))
                initials, faults = symbols // FAULTS, np.bincount(symbols % FAULTS, minlength=FAULTS)
                pairs = initials[:-1] * 10 + initials[1:]
                illegal = len(pairs) - int(np.isin(pairs, [int(x) for x in LEGAL]).sum())
                out.append((letters, closing(end) if last.as_py() else "", cost if first.as_py() else 0, int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[TRUNCATED]), illegal, int(initials[0]), int(initials[-1])))
            columns = zip(*out, strict=True) if out else [[] for _ in made]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(list(c), pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)]], names=[*kept, *made])

    return alone.mapInArrow(run, f"conv_id {kind}, chunk long, rows array<long>, letters string, tail string, {', '.join(f'{c} long' for c in made[2:])}")


def _chained(long: DataFrame) -> DataFrame:
    """Chunks of conversations that have several, with the state in which each begins and the costs after it. What meets in a task is a matrix, or four states, for each CHUNK rows."""
    kind = long.schema["conv_id"].dataType.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[x for row in matrix(_symbols(s)) for x in row] for s in batch.column("symbols")]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(made, pa.list_(pa.int64()))], names=["conv_id", "chunk", "matrix"])

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        v, after = END, []
        for flat in reversed(group["matrix"].tolist()):
            after.append(list(v))
            v = applied(tuple(tuple(int(x) for x in flat[4 * q : 4 * q + 4]) for q in STATES), v)
        return pd.DataFrame({"chunk": group["chunk"], "after": after[::-1], "first": group["chunk"] == group["chunk"].min(), "last": group["chunk"] == group["chunk"].max()})

    costs = long.select("conv_id", "chunk", "symbols").mapInArrow(matrices, f"conv_id {kind}, chunk long, matrix array<long>").groupBy("conv_id").applyInPandas(backwards, "chunk long, after array<long>, first boolean, last boolean")
    told = stored(long.join(costs, "chunk"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[edits(_symbols(s), q, tuple(a.as_py()))[1] for q in STATES] for s, a in zip(batch.column("symbols"), batch.column("after"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(made, pa.list_(pa.int32()))], names=["conv_id", "chunk", "ends"])

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        state, begins = NOTHING, []
        for to in group["ends"]:
            begins.append(state)
            state = int(to[state])
        return pd.DataFrame({"chunk": group["chunk"], "state": begins})

    states = told.select("conv_id", "chunk", "symbols", "after").mapInArrow(ends, f"conv_id {kind}, chunk long, ends array<int>").groupBy("conv_id").applyInPandas(forwards, "chunk long, state int")
    return told.join(states, "chunk").select("conv_id", "chunk", "rows", "symbols", "state", "after", "first", "last")
