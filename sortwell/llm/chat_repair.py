"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.session import map_arrow, settle, table

ROLES = ("system", "user", "assistant")
#: States are "nothing yet" (0) and "the last turn has role k - 1" (1 to 3). A conversation may end after an assistant's turn, or be empty.
START, ACCEPT = 0, 3
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: What a merge into the turn before, a relabel and an inserted empty turn cost.
MERGE, RELABEL, INSERT = 2, 5, 3
FAR = 1 << 40
#: A path's weight is its cost above so many bits and, below, the sum of its turns' tie-breakers, which are far smaller.
TIE_BITS, TIE = 60, (1 << 28) - 1
#: Turns and characters of text that a chunk of a conversation holds at most (one turn at least).
CHUNK_TURNS, CHUNK_CHARS = 256, 1 << 20

OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest runs of inserted turns from state to state."""
    out = {}
    for s in range(4):
        out[s, s] = ()
        seen, layer = {s}, [(s, ())]
        while layer:
            following = []
            for at, run in layer:
                for t in NEXT[at]:
                    if t not in seen:
                        seen.add(t)
                        out[s, t] = (*run, t)
                        following.append((t, (*run, t)))
            layer = following
    return out


PATHS = _paths()


def _steps(role: int) -> list[list[tuple[int, tuple[int, ...], bool]]]:
    """For a turn of role number ``role`` (3: unknown), by states before and after: cost, turns inserted first, whether it merges."""
    out = [[(FAR, (), False)] * 4 for _ in range(4)]
    for s in range(4):
        for (a, q), run in PATHS.items():
            if a != s:
                continue
            for t in range(1, 4):
                cost = INSERT * len(run) + RELABEL * (t - 1 != role)
                for merge in (False, True):
                    if (merge and q != t) or (not merge and t not in NEXT[q]):
                        continue
                    choice = (cost + MERGE * merge, run, merge)
                    if (choice[0], len(run), merge) < (out[s][t][0], len(out[s][t][1]), out[s][t][2]):
                        out[s][t] = choice
    return out


STEPS = [_steps(r) for r in range(4)]


def role_number(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 3


def compose(a: list[int], b: list[int]) -> list[int]:
    """The min-plus product of two 4 x 4 cost matrices, by rows."""
    return [min(FAR << TIE_BITS, *(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]


def turn_weights(turn, role: str | None, text: str | None) -> list[int]:
    """A turn's 4 x 4 matrix of weights, by states before and after, as rows.

    Equal costs are told apart by a hash of the turn and the state after it, so the
    cheapest path is the same one however a conversation is cut.
    """
    h = zlib.crc32(f"{turn}|{role}|{text}".encode())
    steps = STEPS[role_number(role)]
    ties = [(h * k >> 8) & TIE for k in (0x1F35, 0x2C1B3C6D, 0x297A2D39, 0x1B873593)]
    return [(steps[i][j][0] << TIE_BITS) + ties[j] for i in range(4) for j in range(4)]


NEUTRAL = [0 if i == j else FAR << TIE_BITS for i in range(4) for j in range(4)]


def matrix(turns: list[tuple]) -> list[int]:
    """Least weight from each state to each over a run of turns."""
    out = NEUTRAL
    for t in turns:
        out = compose(out, turn_weights(*t))
    return out


def packed(weights: list[int]) -> list[int]:
    """Weights as pairs of 64-bit numbers."""
    return [x for w in weights for x in (w >> TIE_BITS, w & ((1 << TIE_BITS) - 1))]


def unpacked(pairs: list[int]) -> list[int]:
    return [(a << TIE_BITS) + b for a, b in zip(pairs[::2], pairs[1::2], strict=True)]


def ending(state: int) -> int:
    return INSERT * len(PATHS[state, ACCEPT])


def walk(costs: list[list[int]], entry: int, exit_: int | None) -> list[int]:
    """States after each of the runs with these cost matrices, from ``entry`` to ``exit_`` (None: the cheapest ending)."""
    best, back = [0 if s == entry else FAR << TIE_BITS for s in range(4)], []
    for m in costs:
        options = [[(best[i] + m[4 * i + j], i) for i in range(4)] for j in range(4)]
        picked = [min(o) for o in options]
        back.append([i for _, i in picked])
        best = [c for c, _ in picked]
    state = exit_ if exit_ is not None else min(range(1, 4), key=lambda s: (best[s] + (ending(s) << TIE_BITS), s))
    out = []
    for b in reversed(back):
        out.append(state)
        state = b[state]
    return out[::-1]


def repair(turns: list[tuple], entry: int = START, exit_: int | None = None, last: bool = True) -> list[tuple[str, str, list[str], int, str]]:
    """For each (turn, role, text): role, action, roles of inserted empty turns, cost, rendered piece.

    The pieces in order are the rendered conversation. ``entry``, ``exit_`` and
    ``last`` say how a chunk stands in its conversation.
    """
    roles = [role_number(r) for _, r, _ in turns]
    out, state = [], entry
    states = walk([turn_weights(*t) for t in turns], entry, exit_)
    for n, (after, r) in enumerate(zip(states, roles, strict=True)):
        cost, run, merge = STEPS[r][state][after]
        at, piece = state, []
        for t in run:
            piece.append((CLOSE if at else "") + OPEN.format(ROLES[t - 1]))
            at = t
        piece.append(JOIN if merge else (CLOSE if at else "") + OPEN.format(ROLES[after - 1]))
        piece.append(turns[n][2] or "")
        inserted = [ROLES[t - 1] for t in run]
        if last and n == len(turns) - 1:
            tail = PATHS[after, ACCEPT]
            cost += INSERT * len(tail)
            inserted += [ROLES[t - 1] for t in tail]
            piece += [CLOSE + OPEN.format(ROLES[t - 1]) for t in tail] + [CLOSE]
        action = ("merge" if merge else "keep") + ("_relabel" if r != after - 1 else "")
        out.append((ROLES[after - 1], action, inserted, cost, "".join(piece)))
        state = after
    return out


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input turn: conversation, turn, ``role, action, inserted, cost, rendered``.

    Turns are ordered by ``turn_col`` (null first), then by a hash of role and text, so
    the ranges by which they are dealt hold no texts. The legal
    order is an optional system turn, then user and assistant in turns, the assistant
    last. Merging a turn into the one before, relabelling it and inserting empty
    turns before it (or after the last) cost MERGE, RELABEL and INSERT each; the total
    of a conversation is least; a hash of the turns settles ties alike at every
    partitioning. The ``rendered`` pieces of a conversation, in order, are its formatted text.

    Unknown and null roles have to be relabelled; null texts are empty; rows without
    a conversation id are one conversation; repeated rows are repeated turns; other
    columns are not read, so none can clash; an empty table gives no rows.

    Turns are dealt by ranges of the order, so a conversation of any length is spread
    over tasks, and cut into bounded chunks. A chunk that a neighbour continues is
    summed up by its 4 x 4 matrix of least costs; matrices are composed by task and
    then over the tasks of a conversation, which settles the states at which every
    chunk is entered and left. Other conversations are repaired where they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    key = f"conv {kinds[conv_col]}"
    plain = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # equal rows may stand in any order, so their place is drawn: many copies are many tasks' work
    placed = plain.withColumn("place", F.xxhash64("role", "text")).withColumn("draw", F.rand(4))
    order = ["conv", "turn", "place", "role", "text"]
    ordered = placed.repartitionByRange("conv", "turn", "place", "draw").sortWithinPartitions(*order).select("conv", "turn", "role", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []  # rows of the chunk at hand
        rows = chars = 0
        conv, first, grown = None, True, False  # grown: the conversation at hand has given a chunk already

        def chunk(edge: bool) -> pa.RecordBatch:
            nonlocal held, rows, chars, no
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ends = pa.array([0, rows], pa.int32())
            cols = [whole.column(0).slice(0, 1), pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([edge])]
            cols += [pa.ListArray.from_arrays(ends, whole.column(k)) for k in (1, 2, 3)]
            held, rows, chars, no = [], 0, 0, no + 1
            return pa.RecordBatch.from_arrays(cols, names=["conv", "part", "no", "open", "turns", "roles", "texts"])

        for batch in batches:
            start = 0
            sizes = pc.fill_null(pc.utf8_length(batch.column(3)), 0).to_pylist()
            for i, (c, n) in enumerate(zip(batch.column(0).to_pylist(), sizes, strict=True)):
                other = rows > 0 and c != conv
                if other or (rows and (rows >= CHUNK_TURNS or chars + n > CHUNK_CHARS)):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    start = i
                    yield chunk(not other or first or grown)
                    first, grown = first and not other, not other
                conv, rows, chars = c, rows + 1, chars + n
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if rows:
            yield chunk(True)  # the next task may go on with it

    chunks = settle(map_arrow(ordered, cut, f"{key}, part int, no int, open boolean, turns array<{kinds[turn_col]}>, roles array<{kinds[role_col]}>, texts array<{kinds[text_col]}>"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = [packed(matrix(list(zip(*t, strict=True)))) for t in zip(*(b.column(c).to_pylist() for c in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "part", "no", "costs"])

    def composed(t: pa.Table) -> pa.Table:
        total = None
        for m in map(unpacked, t.sort_by("no")["costs"].to_pylist()):
            total = m if total is None else compose(total, m)
        return pa.table([t["conv"].slice(0, 1), t["part"].slice(0, 1), pa.array([packed(total)], pa.list_(pa.int64()))], names=["conv", "part", "costs"])

    def through_parts(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        states = walk(list(map(unpacked, t["costs"].to_pylist())), START, None)
        n = len(states)
        return pa.table([t["conv"], t["part"], pa.array([START, *states[:-1]], pa.int32()), pa.array(states, pa.int32()), pa.array([i == n - 1 for i in range(n)])], names=["conv", "part", "enter", "leave", "final"])

    def through_chunks(t: pa.Table) -> pa.Table:
        t = t.sort_by("no")
        states = walk(list(map(unpacked, t["costs"].to_pylist())), t["enter"][0].as_py(), t["leave"][0].as_py())
        n, final = len(states), t["final"][0].as_py()
        return pa.table([t["part"], t["no"], pa.array([t["enter"][0].as_py(), *states[:-1]], pa.int32()), pa.array(states, pa.int32()), pa.array([final and i == n - 1 for i in range(n)])], names=["part", "no", "enter", "leave", "final"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                conv, turn, roles, texts, enter, leave, final = (b.column(c)[r] for c in range(7))
                done = repair(list(zip(turn.as_py(), roles.as_py(), texts.as_py(), strict=True)), enter.as_py(), leave.as_py(), final.as_py())
                n = len(done)
                cols = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * n, conv.type), turn.values, pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.int64()), pa.array(cols[4])], names=["conv", "turn", "role", "action", "inserted", "cost", "rendered"])

    costs = map_arrow(chunks.where("open").select("conv", "part", "no", "turns", "roles", "texts"), matrices, f"{key}, part int, no int, costs array<long>")
    costs = settle(costs, "costs")
    by_part = costs.groupBy("conv", "part").applyInArrow(composed, f"{key}, part int, costs array<long>")
    parts = by_part.groupBy("conv").applyInArrow(through_parts, f"{key}, part int, enter int, leave int, final boolean")
    parts = settle(parts.withColumnRenamed("conv", "_conv").withColumnRenamed("part", "_part"), "states")
    inside = costs.join(parts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    states = inside.groupBy("conv", "part").applyInArrow(through_chunks, "part int, no int, enter int, leave int, final boolean")
    held = chunks.where("open").join(states, ["part", "no"]).select("conv", "turns", "roles", "texts", "enter", "leave", "final")
    whole = chunks.where("NOT open").select("conv", "turns", "roles", "texts", F.lit(START).alias("enter"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("final"))
    out = map_arrow(whole.union(held), render, f"{key}, turn {kinds[turn_col]}, role string, action string, inserted array<string>, cost long, rendered string")
    return out.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)


def op4_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
