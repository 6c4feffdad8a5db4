"""Groups of related rows: greedy leaders, ordered merging, components.

Groups are rows ``key, group_no, idx``, one per member, so that no group has to fit into a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortwell.operators.components import connected_components
from sortwell.operators.edges import cosines, scaled, vector_classes
from sortwell.operators.index import with_position
from sortwell.operators.match import same_join
from sortwell.operators.runs import by_group, starts
from sortwell.session import map_arrow, release, settle

#: Positions of a label that a task settles among themselves, and edges (or rows of groups) that are few enough for one step.
BLOCK, AT_ONCE = 1 << 18, 500_000
#: Numbers in the vectors that a task of ``vector_leaders`` scans at most, positions in the steps by which it counts them, and rows and leaders that are compared at a time.
SCANNED, STEP, ROWS, LEADERS = 1 << 21, 256, 256, 4096


def _decided(live: DataFrame, block: int | None) -> DataFrame:
    """``k, x, lead``: the rows that can be told leaders (``lead`` is ``x``) or members by the edges ``k, i, j`` alone.

    A task takes a range of ``block`` positions with all edges that end there, sorted, and
    scans them as one scan of the label would: it remembers what became of the
    positions of its range, and nothing of the edges. A position stays open where a
    smaller neighbour of another range may lead. Without ``block`` a label is one range,
    and ``lead`` is a member's least leader.
    """
    own = lambda x: F.struct(F.col(x).alias("j"), F.col("i").alias("i"))
    start = (F.floor(F.col("j") / block) * block if block else F.lit(-(1 << 62))).cast("long")
    # each smaller end is a position of its own range too
    ends = live.select("k", F.inline(F.array(own("j"), own("i")))).withColumn("start", start)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        status: dict[int, int] = {}  # a leader by itself, -1 for a member
        at, lead, open_, last = None, None, False, None

        def outcome() -> int | None:
            if lead is None and open_:
                return None
            status[at] = at if lead is None else -1
            return at if lead is None else lead

        for batch in batches:
            keys = batch.column(0)
            fresh = starts(batch, ["k", "start"], last)
            rows, found, leads = [], [], []
            for r, (new, j, i, first) in enumerate(zip(fresh.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if new or j != at:
                    if at is not None and (x := outcome()) is not None:
                        rows.append(r)
                        found.append(at)
                        leads.append(x)
                    if new:
                        status = {}
                    at, lead, open_ = j, None, False
                if i != j:
                    s = status.get(i) if i >= first else None
                    if s is None:
                        open_ = True
                    elif s >= 0 and (lead is None or s < lead):
                        lead = s
            before = keys.slice(0, 1) if last is None else last.column(0)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([before, keys]).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64()), pa.array(leads, pa.int64())], names=["k", "x", "lead"])
            last = batch.slice(batch.num_rows - 1) if batch.num_rows else last
        if at is not None and (x := outcome()) is not None:
            yield pa.RecordBatch.from_arrays([last.column(0), pa.array([at], pa.int64()), pa.array([x], pa.int64())], names=["k", "x", "lead"])

    kind = live.schema["k"].dataType.simpleString()
    return map_arrow(ends.repartition("k", "start").sortWithinPartitions("k", "start", "j", "i"), scan, f"k {kind}, x long, lead long")


def leader_groups(edges: DataFrame, key: str = "label") -> DataFrame:
    """``key, leader, idx`` of greedy groups over edges ``key, i, j`` (i < j), leaders included.

    A scan by position would make each free row a leader that takes every later free
    neighbour. The leaders are the lexicographically first maximal independent set
    among rows with edges, and a member goes to its least adjacent leader. Each round
    settles ranges of positions in tasks of their own (see ``_decided``), then drops the
    edges whose end is decided or whose start is a member; the first open range of
    a label is always settled whole, so a label of n positions takes n / ``BLOCK`` rounds at
    most. As soon as no more than ``AT_ONCE`` edges are left, one step settles them.
    Leaders without members are not groups.

    Edges marked ``copy`` go from the smallest position of a class of equal rows to the
    others. All of a class have the same neighbours, so its smallest position decides
    for it, and the others follow. A null label is a label.
    """
    copies = edges.where("copy").select(F.col(key).alias("k"), F.col("i").alias("rep"), F.col("j").alias("idx")) if "copy" in edges.columns else None
    live = edges.where("NOT copy") if copies is not None else edges
    live = first = settle(live.select(F.col(key).alias("k"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")), "edges")
    left, leaders = live.count(), None
    while left > AT_ONCE:
        found = settle(_decided(live, BLOCK), "decided")
        lead = found.where("lead = x").select("k", "x")
        taken = same_join(live, lead.withColumnRenamed("x", "i"), ["k", "i"], "left_semi").select("k", F.col("j").alias("x"))
        gone = settle(found.select("k", "x").union(taken).distinct(), "gone")
        rest = settle(same_join(same_join(live, gone.withColumnRenamed("x", "j"), ["k", "j"], "left_anti"), gone.withColumnRenamed("x", "i"), ["k", "i"], "left_anti"), "edges")
        # an open row that has lost its last edge leads
        both = lambda e: e.select("k", F.col("i").alias("x")).union(e.select("k", F.col("j").alias("x"))).distinct()
        alone = same_join(same_join(both(live), gone, ["k", "x"], "left_anti"), both(rest), ["k", "x"], "left_anti")
        leaders = lead.union(alone) if leaders is None else leaders.union(lead).union(alone)
        leaders = settle(leaders, "leaders")
        if live is not first:
            release(live)
        live, before, left = rest, left, rest.count()
        if left >= before:
            raise RuntimeError("a round over the edges decided nothing")
    found = settle(_decided(live, None), "decided")
    if leaders is None:
        members = found.where("lead <> x").select("k", F.col("lead").alias("leader"), F.col("x").alias("idx"))
    else:
        every = settle(leaders.union(found.where("lead = x").select("k", "x")), "leaders")
        followers = same_join(same_join(first, every.withColumnRenamed("x", "j"), ["k", "j"], "left_anti"), every.withColumnRenamed("x", "i"), ["k", "i"], "left_semi")
        members = settle(followers.groupBy("k", F.col("j").alias("idx")).agg(F.min("i").alias("leader")).select("k", "leader", "idx"), "members")
    if copies is not None:
        led = same_join(copies, members.select("k", F.col("idx").alias("rep"), "leader"), ["k", "rep"], "left")
        members = members.union(led.select("k", F.coalesce("leader", "rep").alias("leader"), "idx"))
    heads = members.select("k", "leader", F.col("leader").alias("idx")).distinct()
    return members.union(heads).withColumnRenamed("k", key)


class _Leaders:
    """Vectors of leaders, to which rows are compared in pieces; the first that a row is near to is its leader."""

    def __init__(self, threshold: float):
        self.threshold, self.pieces = threshold, []

    def add(self, at: np.ndarray, m: np.ndarray, mm: np.ndarray) -> None:
        if self.pieces and len(self.pieces[-1][0]) + len(at) <= LEADERS:
            at, m, mm = (np.concatenate(x) for x in zip(self.pieces.pop(), (at, m, mm), strict=True))
        self.pieces.append((at, m, mm))

    def of(self, m: np.ndarray, mm: np.ndarray) -> np.ndarray:
        """The first near leader of each row, or -1."""
        out = np.full(len(m), -1, np.int64)
        for at, b, bb in self.pieces:
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            near = cosines(m[open_], mm[open_], b, bb) > self.threshold
            hit = near.any(axis=1)
            out[open_[hit]] = at[near[hit].argmax(axis=1)]
        return out


def _led(keys: pa.Table, at: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    """``label, level, dim, idx, lead`` of rows of one group."""
    same = pa.array(np.zeros(len(at), np.int64))
    return pa.RecordBatch.from_arrays([*(keys[k].combine_chunks().slice(0, 1).take(same) for k in ("label", "level", "dim")), pa.array(at), pa.array(lead)], names=["label", "level", "dim", "idx", "lead"])


def _scan_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's leader, itself included, in one scan of the rows of a group by position."""
    for t in by_group(batches, ["label", "level", "dim"]):
        threshold, at = t["t"][0].as_py(), t["idx"].to_numpy()
        m, mm = scaled(t)
        led, out = _Leaders(threshold), np.empty(len(at), np.int64)
        for a in range(0, len(at), ROWS):
            here = slice(a, a + ROWS)
            lead = led.of(m[here], mm[here])
            rest = np.flatnonzero(lead < 0) + a
            near = cosines(m[rest], mm[rest], m[rest], mm[rest]) > threshold
            of = np.full(len(rest), -1, np.int64)
            for r in range(len(rest)):
                if of[r] < 0:
                    of[r:][(of[r:] < 0) & near[r, r:]] = at[rest[r]]
                    of[r] = at[rest[r]]
            lead[rest - a] = of
            new = rest[of == at[rest]]
            if len(new):
                led.add(at[new], m[new], mm[new])
            out[here] = lead
        yield _led(t, at, out)


def _follow_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first near leader of each row of a group that is none, or -1; leaders (``leads``) come first, by position."""
    for t in by_group(batches, ["label", "level", "dim", "chunk"]):
        n, at = int(t["leads"].to_numpy(zero_copy_only=False).sum()), t["idx"].to_numpy()
        m, mm = scaled(t)
        led = _Leaders(t["t"][0].as_py())
        for a in range(0, n, LEADERS):
            led.add(at[a : min(n, a + LEADERS)], m[a : min(n, a + LEADERS)], mm[a : min(n, a + LEADERS)])
        for a in range(n, len(at), ROWS):
            yield _led(t, at[a : a + ROWS], led.of(m[a : a + ROWS], mm[a : a + ROWS]))


def vector_leaders(items: DataFrame, limits: dict[str, float], vec: str = "v", key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, level, leader, idx``: what ``leader_groups(cosine_edges(items, t))`` gives for each level and its ``t``, without the links.

    A scan compares a row to leaders only, so there is no need to find, write and shuffle links between
    members, which are many where many vectors are alike. Equal vectors are one row of the scan. Each round
    takes the first open rows of every label and level, ``SCANNED`` numbers at most, scans them in
    a task and sends the leaders found to the later open rows, dealt by ranges of positions; what is
    near to one follows the first such. A label of n vectors with L leaders takes about n * L
    comparisons and one round for each ``SCANNED`` numbers in rows that no earlier round decided.
    """
    if min(limits.values()) <= 0:
        raise ValueError("thresholds above 0 are needed")
    classes, firsts = vector_classes(items, vec, key, idx)
    kind = classes.schema["label"].dataType.simpleString()
    schema, by = f"label {kind}, level string, dim int, idx long, lead long", ["label", "level", "dim"]
    levels = F.array(*[F.struct(F.lit(name).alias("level"), F.lit(float(t)).alias("t")) for name, t in limits.items()])
    live = settle(firsts.select("label", "dim", "idx", "v", F.inline(levels)), "open")
    decided, left = None, live.count()
    while left:
        step = F.floor(F.col("idx") / STEP)
        counts = live.groupBy(*by, step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("step"))
        cuts = counts.withColumn("rows", upto).where((F.col("rows") == F.col("n")) | (F.col("rows") * F.col("dim") <= SCANNED)).groupBy(*by).agg(((F.max("step") + 1) * STEP).alias("cut"))
        cut = same_join(live, settle(cuts, "cuts"), by)
        heads = cut.where("idx < cut").select(*by, "t", "idx", "v")
        scanned = settle(map_arrow(heads.repartition(*by).sortWithinPartitions(*by, "idx"), _scan_vectors, schema), "decided")
        decided = scanned if decided is None else decided.union(scanned)
        rest = cut.where("idx >= cut").withColumn("chunk", F.floor(F.col("idx") * F.col("dim") / SCANNED))
        leads = same_join(live, scanned.where("lead = idx").select(*by, "idx"), [*by, "idx"], "left_semi")
        sent = same_join(leads, rest.select(*by, "chunk").distinct(), by).withColumn("leads", F.lit(True))
        both = sent.unionByName(rest.drop("cut").withColumn("leads", F.lit(False))).select(*by, "chunk", "leads", "t", "idx", "v")
        keys = [*by, "chunk"]
        if scanned.count() == left:
            break
        followed = settle(map_arrow(both.repartition(*keys).sortWithinPartitions(*keys, F.col("leads").desc(), "idx"), _follow_vectors, schema), "decided")
        decided = decided.union(followed.where("lead >= 0"))
        still = settle(same_join(live, followed.where("lead < 0").select(*by, "idx"), [*by, "idx"], "left_semi"), "open")
        release(live)
        live, left = still, still.count()
    if decided is None:
        decided = live.select("label", "level", "dim", "idx", F.col("idx").alias("lead"))
    members = decided.where("lead <> idx").select("label", "level", F.col("lead").alias("leader"), "idx")
    copies = same_join(classes.where("idx <> rep").select("label", "rep", "idx"), decided.select("label", "level", F.col("idx").alias("rep"), "lead"), ["label", "rep"])
    members = settle(members.union(copies.select("label", "level", F.col("lead").alias("leader"), "idx")), "members")
    heads = members.select("label", "level", "leader", F.col("leader").alias("idx")).distinct()
    return members.union(heads).withColumnRenamed("label", key)


def numbered_groups(members: DataFrame, levels: list[str], key: str = "label") -> DataFrame:
    """``key, group_no, idx`` from ``key, level, lead, idx``: groups numbered from 1 in order of level, then of their lead."""
    members = settle(members, "members")
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level"))
    heads = with_position(members.select(key, "level", "lead").distinct().withColumn("at", at), key, [F.col("at"), F.col("lead")], "no")
    return same_join(members, heads.select(key, "level", "lead", "no"), [key, "level", "lead"]).select(key, (F.col("no") + 1).alias("group_no"), "idx").distinct()


def _scanned(flat: DataFrame) -> DataFrame:
    """``k, group_no, lead`` of groups ``k, group_no, idx``, a label in one task: the first open group that shares a row, or itself."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["k"]):
            owner: dict[int, int] = {}  # the leading group of a row; leading groups share none
            groups: dict[int, list[int]] = {}
            for no, i in zip(t["group_no"].to_pylist(), t["idx"].to_pylist(), strict=True):
                groups.setdefault(no, []).append(i)
            leads = []
            for no, members in groups.items():
                met = min((owner[i] for i in members if i in owner), default=no)
                if met == no:
                    owner |= dict.fromkeys(members, no)
                leads.append(met)
            k = t["k"].combine_chunks().slice(0, 1)
            yield pa.RecordBatch.from_arrays([k.take(pa.array([0] * len(groups))), pa.array(list(groups), pa.int64()), pa.array(leads, pa.int64())], names=["k", "group_no", "lead"])

    kind = flat.schema["k"].dataType.simpleString()
    return map_arrow(flat.repartition("k").sortWithinPartitions("k", "group_no"), scan, f"k {kind}, group_no long, lead long")


def merge_single_pass(groups: DataFrame, key: str = "label") -> DataFrame:
    """``key, group_no, idx``: the first group absorbs all later ones that it overlaps, once; then the next.

    What a group absorbed does not make it absorb more, so results may overlap. A group
    absorbs by its own rows only, so the pass is a leader problem over groups, solved
    in rounds over rows: a group that is the first of the open ones in all its rows
    leads, and the open groups that share a row with it are absorbed. Groups that lead
    share no row, so a row names the leader of each group in it, and the least one is
    where an absorbed group goes. No pair of groups is ever written. Each round decides
    at least the first open group of each label; as soon as no more than ``AT_ONCE`` rows
    are left, one step scans them.
    """
    number = lambda c: F.col(c).cast("long").alias(c)
    live = flat = settle(groups.select(F.col(key).alias("k"), number("group_no"), number("idx")).distinct(), "groups")
    leads, left = None, flat.count()
    while left > AT_ONCE:
        seen = same_join(live, live.groupBy("k", "idx").agg(F.min("group_no").alias("least")), ["k", "idx"])
        lead = settle(seen.groupBy("k", "group_no").agg(F.min("least").alias("least")).where("least = group_no").select("k", "group_no"), "leaders")
        leads = lead if leads is None else settle(leads.union(lead), "leaders")
        held = same_join(live, lead, ["k", "group_no"], "left_semi").select("k", "idx")
        met = same_join(live, held, ["k", "idx"], "left_semi").select("k", "group_no").distinct()
        rest = settle(same_join(live, met, ["k", "group_no"], "left_anti"), "groups")
        if live is not flat:
            release(live)
        live, before, left = rest, left, rest.count()
        if left >= before:
            raise RuntimeError("a round over the groups decided nothing")
    scanned = settle(_scanned(live), "leaders")
    if leads is None:
        merged = same_join(flat, scanned, ["k", "group_no"]).select("k", F.col("lead").alias("group_no"), "idx").distinct()
        return merged.withColumnRenamed("k", key)
    leads = settle(leads.union(scanned.where("lead = group_no").select("k", "group_no")), "leaders")
    own = settle(same_join(flat, leads, ["k", "group_no"], "left_semi"), "leading")
    others = same_join(flat, leads, ["k", "group_no"], "left_anti")
    into = same_join(others, own.withColumnRenamed("group_no", "lead"), ["k", "idx"]).groupBy("k", "group_no").agg(F.min("lead").alias("lead"))
    absorbed = same_join(others, into, ["k", "group_no"]).select("k", F.col("lead").alias("group_no"), "idx")
    return own.union(absorbed).distinct().withColumnRenamed("k", key)


def merge_components(groups: DataFrame, key: str = "label") -> DataFrame:
    """``key, group_no, idx``: groups merged as long as any share a row; results are disjoint and numbered by their first group."""
    flat = settle(groups.select(F.col(key).alias("k"), "group_no", "idx").distinct(), "groups")
    heads = flat.groupBy("k", "group_no").agg(F.min("idx").alias("head"))
    node = lambda n: F.struct("k", F.col(n).alias("x"))
    linked = same_join(flat, heads, ["k", "group_no"])
    comps = connected_components(linked.select(node("idx").alias("a"), node("head").alias("b")))
    named = same_join(flat, comps.select(F.col("node.k").alias("k"), F.col("node.x").alias("idx"), F.col("component.x").alias("comp")), ["k", "idx"], "left").withColumn("comp", F.coalesce("comp", "idx"))
    named = settle(named, "members")
    numbers = named.groupBy("k", "comp").agg(F.min("group_no").alias("first"))
    return same_join(named.select("k", "comp", "idx").distinct(), numbers, ["k", "comp"]).select(F.col("k").alias(key), F.col("first").alias("group_no"), "idx")
