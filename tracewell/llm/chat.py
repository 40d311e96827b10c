"""Chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, first; then user and assistant turns in alternation,
beginning with user and ending with assistant. Repair finds, by dynamic programming over the automaton of
those rules, the cheapest way to read the turns as a legal conversation:

    keep      the turn's role follows legally                     0
    merge     join the turn to the one before it, of one role     1
    relabel   give the turn another role (then keep or merge)     2 more
    insert    put an empty turn before it, or at the end          3 each

Of equal costs the first in the order of _moves is taken. The steps of the automaton compose by
min-plus products, so a conversation is cut into chunks of CHUNK turn numbers: conversations of more than
one chunk first get each chunk's matrix of costs from state to state (roles only, no texts), from which the states at
the cuts follow; then every chunk is repaired and rendered by itself. A conversation may hold a third of
all rows: a task holds one chunk's turns, or for a cut conversation 16 numbers a chunk. A chunk of more than CROWDED
rows, of null or repeated turn numbers, is cut further, by the rows' places in order, into parts of CHUNK rows.

Rendered pieces, one for each turn and each inserted turn, concatenate in order of (chunk, seq) to the
whole conversation: <|role|>\\ntext<|end|>\\n, the parts of a merged turn being joined by \\n\\n.

Defined results: roles compare stripped and lower-cased, and one that is null or unknown must be relabelled;
a null text is an empty one; turns with one number (ties, repeated rows) are ordered by role, then text, null
first; null numbers come first; a null conv_id is a conversation of its own; an empty table gives an empty
table. Other columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._common import cut, id_column, need, null_id_back

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
CHUNK = 256
#: Up to so many rows a chunk stays whole.
CROWDED = 1_024
#: Pieces of a part of a chunk, at most: a turn has two inserted before it, and two end a conversation.
PIECES = 4 * CHUNK
FAR = 1 << 40
#: States at cuts are broadcast up to so many chunks (some 40 bytes each).
BROADCAST_CHUNKS = 100_000


@cache
def _inserted(start: int, to: int) -> tuple[int, ...] | None:
    """The fewest empty turns after `start` that let `to` follow."""
    if to in FOLLOWS[start]:
        return ()
    paths, seen = [(s,) for s in FOLLOWS[start] if s != SYSTEM], {start}
    while paths:
        longer = []
        for p in paths:
            if to in FOLLOWS[p[-1]]:
                return p
            if p[-1] not in seen:
                seen.add(p[-1])
                longer += [(*p, s) for s in FOLLOWS[p[-1]]]
        paths = longer
    return None


@cache
def _moves(state: int, role: int) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """(cost, next state, action, inserted before) for a turn; role 0 is an unknown one."""
    out = []
    for to in (role, *(r for r in (USER, ASSISTANT, SYSTEM) if r != role)):
        if to == START:
            continue
        base, name = (0, "keep") if to == role else (RELABEL, "relabel")
        between = _inserted(state, to)
        if between is not None:
            out.append((base + INSERT * len(between), to, name, between))
        if to == state:
            out.append((base + MERGE, to, "merge" if to == role else "relabel_merge", ()))
    return tuple(sorted(out, key=lambda m: m[0]))


#: Empty turns that end a conversation legally, by state.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _forward(costs: list[int], roles: Iterable[int]) -> tuple[list[int], list[list]]:
    """Least costs by state after the turns, and for each turn and state how it was reached."""
    trail = []
    for role in roles:
        new, how = [FAR] * 4, [None] * 4
        for state, cost in enumerate(costs):
            if cost < FAR:
                for move in _moves(state, role):
                    if cost + move[0] < new[move[1]]:
                        new[move[1]], how[move[1]] = cost + move[0], (state, move)
        costs = new
        trail.append(how)
    return costs, trail


def repair(roles: list[int], entry: int = START, leave: int | None = None, last: bool = True) -> tuple[int, list[tuple[int, str, tuple[int, ...]]], tuple[int, ...]]:
    """Cost; (role, action, inserted before) for each turn; turns inserted at the end. leave: the state that
    must be reached; last: whether the conversation ends here."""
    start = [FAR] * 4
    start[entry] = 0
    costs, trail = _forward(start, roles)
    total = [c + INSERT * len(ENDINGS[s]) * last for s, c in enumerate(costs)]
    state = min(range(4), key=total.__getitem__) if leave is None else leave
    cost, ending, out = total[state], ENDINGS[state] if last else (), []
    for how in reversed(trail):
        before, move = how[state]
        out.append((state, move[2], move[3]))
        state = before
    return cost, out[::-1], ending


def role_code(role: Column) -> Column:
    r = F.lower(F.trim(role))
    return F.when(r == "system", SYSTEM).when(r == "user", USER).when(r == "assistant", ASSISTANT).otherwise(START).cast("int")


def _runs(rows: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, out of sorted batches."""
    key, held = None, []
    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _states_at_cuts(turns: DataFrame) -> DataFrame:
    """(conv, chunk, part, entry, leave, last) of every part of a chunk of conversations with more than one."""
    place = F.struct("chunk", "part")
    many = turns.groupBy("conv").agg((F.min(place) != F.max(place)).alias("many")).where("many")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk, part), rows in _runs(batches, 3):
            matrix = []
            for s in range(4):
                start = [FAR] * 4
                start[s] = 0
                matrix += _forward(start, [r[1] for r in rows])[0]
            yield pa.RecordBatch.from_pydict({"conv": [conv], "chunk": [chunk], "part": [part], "matrix": [matrix]})

    def trace(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values(["chunk", "part"])
        cost, how = [0, FAR, FAR, FAR], []
        for m in chunks["matrix"]:
            sums = [[cost[s] + int(m[4 * s + t]) for s in range(4)] for t in range(4)]
            how.append([min(range(4), key=x.__getitem__) for x in sums])
            cost = [min(FAR, *x) for x in sums]
        state = min(range(4), key=lambda s: cost[s] + INSERT * len(ENDINGS[s]))
        cuts = [state]
        for h in reversed(how):
            cuts.append(h[cuts[-1]])
        cuts.reverse()
        last = [False] * (len(chunks) - 1) + [True]
        return pd.DataFrame({"conv": chunks["conv"], "chunk": chunks["chunk"], "part": chunks["part"], "entry": cuts[:-1], "leave": cuts[1:], "last": last})

    long = turns.join(many.select("conv"), "conv", "left_semi").select("conv", "chunk", "part", "turn", "role", "role_order")
    by_chunk = long.repartition("conv", "chunk", "part").sortWithinPartitions("conv", "chunk", "part", F.col("turn").asc_nulls_first(), "role_order")
    matrices = by_chunk.select("conv", "chunk", "part", "turn", "role").mapInArrow(costs, "conv long, chunk long, part long, matrix array<long>")
    return matrices.groupBy("conv").applyInPandas(trace, "conv long, chunk long, part long, entry int, leave int, last boolean")


def _in_parts(turns: DataFrame) -> DataFrame:
    """turns with the part of their chunk: 0, or in a crowded chunk a row's place in order, divided by CHUNK. Equal rows
    may stand in any order, so they are dealt over ranges too."""
    keys = cut(turns.groupBy("conv", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("conv", "chunk"))
    n_keys = keys.count()
    if not n_keys:
        return turns.withColumn("part", F.lit(0).cast("long"))
    keys = F.broadcast(keys) if n_keys <= BROADCAST_CHUNKS else keys
    order = [F.col(x).asc_nulls_first() for x in ("conv", "chunk", "turn", "role_order", "text", "tie")]
    crowded = turns.join(keys, ["conv", "chunk"], "left_semi").withColumn("tie", F.monotonically_increasing_id())
    ranged = crowded.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = ranged.join(F.broadcast(starts), "range").withColumn("at", F.col("at") + F.col("shift"))
    firsts = placed.groupBy("conv", "chunk").agg(F.min("at").alias("first"))
    firsts = F.broadcast(firsts) if n_keys <= BROADCAST_CHUNKS else firsts
    parted = placed.join(firsts, ["conv", "chunk"]).withColumn("part", F.floor((F.col("at") - F.col("first")) / CHUNK).cast("long"))
    others = turns.join(keys, ["conv", "chunk"], "left_anti").withColumn("part", F.lit(0).cast("long"))
    return others.unionByName(parted.select(*others.columns))


def render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, chunk long, seq int, turn long, action string, role string, cost long, rendered string): a row
    for each turn (keep, merge, relabel, relabel_merge) and inserted turn (insert, turn null). cost stands
    in the first row of a chunk, or of a part of a crowded one, 0 elsewhere; summed over a conversation it is the repair's cost."""
    need(conversations, conv_col, turn_col, role_col, text_col)
    c = conversations
    turn = c[turn_col].cast("long")
    turns = c.select(
        id_column(conv_col).alias("conv"), F.coalesce(F.floor(turn / CHUNK), F.lit(-(1 << 62))).cast("long").alias("chunk"), turn.alias("turn"), role_code(c[role_col]).alias("role"),
        c[role_col].alias("role_order"), c[text_col].alias("text"),
    )
    turns = _in_parts(turns)
    states = cut(_states_at_cuts(turns.select("conv", "chunk", "part", "turn", "role", "role_order")))
    # no join after the rows of a chunk have been brought together: a join may split them again
    states = F.broadcast(states) if states.count() <= BROADCAST_CHUNKS else states
    placed = turns.join(states, ["conv", "chunk", "part"], "left").repartition("conv", "chunk", "part")
    by_turn = [F.col(x).asc_nulls_first() for x in ("turn", "role_order", "text")]
    placed = placed.sortWithinPartitions("conv", "chunk", "part", *by_turn).select("conv", "chunk", "part", "turn", "role", "text", "entry", "leave", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "chunk", "seq", "turn", "action", "role", "cost", "rendered"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        out: list[tuple] = []
        size = 0
        for (conv, chunk, part), rows in _runs(batches, 3):
            entry, leave, last = rows[0][3:]
            last = True if last is None else last
            cost, steps, ending = repair([r[1] for r in rows], START if entry is None else entry, leave, last)
            pieces: list[list] = []
            open_turn = entry not in (None, START)
            for (turn, _, text, *_), (role, action, before) in zip(rows, steps, strict=True):
                for x in before:
                    pieces.append([None, "insert", ROLES[x - 1], ("<|end|>\n" if open_turn else "") + f"<|{ROLES[x - 1]}|>\n"])
                    open_turn = True
                if action.endswith("merge"):
                    lead = "\n\n"
                else:
                    lead = ("<|end|>\n" if open_turn else "") + f"<|{ROLES[role - 1]}|>\n"
                pieces.append([turn, action, ROLES[role - 1], lead + (text or "")])
                open_turn = True
            for x in ending:
                pieces.append([None, "insert", ROLES[x - 1], f"<|end|>\n<|{ROLES[x - 1]}|>\n"])
            if last:
                pieces[-1][3] += "<|end|>\n"
            # of a chunk that isn't the last, the cost of reaching its leaving state
            for seq, p in enumerate(pieces):
                out.append((conv, chunk, part * PIECES + seq, p[0], p[1], p[2], cost if seq == 0 else 0, p[3]))
                size += len(p[3])
            if size > 2 << 20 or len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    done = placed.mapInArrow(run, "conv long, chunk long, seq int, turn long, action string, role string, cost long, rendered string")
    return done.select(null_id_back(F.col("conv")).alias(conv_col), "chunk", "seq", "turn", "action", "role", "cost", "rendered")
