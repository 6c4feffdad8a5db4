"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortwell.operators.components import connected_components
from sortwell.operators.spread import with_group
from sortwell.session import map_arrow, release, settle, table

COSINE = 0.93
#: Leading principal dimensions in which the grid lies and blocks are told apart.
LEAD = 8
#: Vectors from which the principal dimensions are fitted. They steer what is skipped, never what is found.
FIT_ROWS = 2048
#: Vectors in a block and in the least interval of the recursion; blocks in a side of a tile at most; leaves and pairs of intervals that a task takes at a time.
BLOCK, LEAF, TILE, AT_ONCE = 512, 64, 128, 1 << 14
#: Bytes that the vectors of an interval of a tile take as doubles at most, unless a single block takes more.
TILE_BYTES = 64 << 20


def usable(label: str = "label", vec: str = "v"):
    """Whether a row can link: label and vector given, components finite, not all zero."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(label).isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal(sample: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: mean and leading principal axes of the unit vectors."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim, vs in by_dim.items():
        u = unit(np.stack(vs))
        mean = u.mean(axis=0)
        _, axes = np.linalg.eigh((u - mean).T @ (u - mean))
        out[dim] = (mean, axes[:, ::-1][:, :LEAD])
    return out


def project(u: np.ndarray, axes: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coordinates in the leading dimensions (the first ones where none were fitted), LEAD columns."""
    mean, lead = axes.get(u.shape[1], (0.0, np.eye(u.shape[1])[:, :LEAD]))
    p = (u - mean) @ lead
    return np.pad(p, ((0, 0), (0, LEAD - p.shape[1])))


class IntervalJoin:
    """Links between two sequences in epsilon grid order, or within one, by joining their intervals recursively."""

    def __init__(self, a, b, cosine: float) -> None:
        (self.va, self.pa, self.wa), (self.vb, self.pb, self.wb) = a, b
        self.same, self.cosine = a is b, cosine
        self.ua = unit(self.va)
        self.ub = self.ua if self.same else unit(self.vb)
        self.eps2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-9
        self.shift = 0 if self.same else len(self.ua)
        self.counts = np.zeros(len(self.ua) + (0 if self.same else len(self.ub)), np.int64)
        self.comp = np.arange(len(self.counts))
        self._join(self._boxes(self.pa), self._boxes(self.pb))
        while (up := self.comp[self.comp]).tobytes() != self.comp.tobytes():
            self.comp = up

    @staticmethod
    def _boxes(p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Boxes of the leaves, then of each two neighbouring intervals, up to one interval."""
        at = np.arange(0, len(p), LEAF)
        levels = [(np.minimum.reduceat(p, at), np.maximum.reduceat(p, at))]
        while len(levels[-1][0]) > 1:
            lo, hi = levels[-1]
            at = np.arange(0, len(lo), 2)
            levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
        return levels

    def _join(self, a: list, b: list) -> None:
        top = max(len(a), len(b)) - 1
        zero = np.zeros(1, np.int64)
        todo = [(top, zero, zero)]
        while todo:
            level, i, k = todo.pop()
            (lo_a, hi_a), (lo_b, hi_b) = a[min(level, len(a) - 1)], b[min(level, len(b) - 1)]
            gap = np.maximum(0, np.maximum(lo_b[k] - hi_a[i], lo_a[i] - hi_b[k]))
            near = (gap * gap).sum(axis=1) <= self.eps2
            i, k = i[near], k[near]
            if not level:
                self._leaves(i, k)
                continue
            # an interval that is alone on its level stands for itself below
            half = lambda x, levels: np.stack([2 * x, 2 * x + 1], axis=-1) if level < len(levels) else x[..., None]  # noqa: B023, E731
            left, right = half(i, a), half(k, b)
            i = np.repeat(left, right.shape[-1], axis=-1).ravel()
            k = np.tile(right, (1, left.shape[-1])).ravel()
            there = (i < len(a[min(level - 1, len(a) - 1)][0])) & (k < len(b[min(level - 1, len(b) - 1)][0]))
            if self.same:
                there &= i <= k  # the mirror image is joined
            i, k = i[there], k[there]
            for at in range(0, len(i), AT_ONCE):
                todo.append((level - 1, i[at : at + AT_ONCE], k[at : at + AT_ONCE]))

    def _leaves(self, i: np.ndarray, k: np.ndarray) -> None:
        order = np.lexsort((k, i))
        i, k = i[order], k[order]
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            for at in range(0, len(part), 64):
                some = part[at : at + 64]
                self._compare(int(i[some[0]]), k[some])

    def _compare(self, leaf: int, others: np.ndarray) -> None:
        rows = np.arange(leaf * LEAF, min((leaf + 1) * LEAF, len(self.ua)))
        cols = (others[:, None] * LEAF + np.arange(LEAF)).ravel()
        cols = cols[cols < len(self.ub)]
        sim = self.ua[rows] @ self.ub[cols].T
        linked = sim >= self.cosine
        for x, y in np.argwhere(np.abs(sim - self.cosine) < 1e-9):  # rounding decides: take the quotient itself
            a, b = self.va[rows[x]].astype(np.float64), self.vb[cols[y]].astype(np.float64)
            linked[x, y] = a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= self.cosine
        if self.same:
            linked &= rows[:, None] != cols
        if not linked.any():
            return
        self.counts[rows] += linked @ self.wb[cols]
        other = slice(None) if not self.same else cols // LEAF != leaf
        self.counts[self.shift + cols[other]] += linked[:, other].T @ self.wa[rows]
        cols = cols + self.shift
        while True:
            x, y = self._roots(rows), self._roots(cols)
            apart = linked & (x[:, None] != y)
            open_ = np.flatnonzero(apart.any(axis=1))
            if not len(open_):
                return
            for r, c in zip(open_, apart[open_].argmax(axis=1), strict=True):
                p, q = self._roots(rows[r]), self._roots(cols[c])
                self.comp[max(p, q)] = min(p, q)

    def _roots(self, x):
        up = self.comp[x]
        while np.any((above := self.comp[up]) != up):
            up = above
        return up


def _blocks(reps: DataFrame, axes, id_type: str, label_type: str, width: str) -> DataFrame:
    """Blocks of the vectors in epsilon grid order, with the box that holds each."""
    eps = float(np.sqrt(2 - 2 * COSINE))
    kind = np.float32 if width == "float" else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, LEAD))
            vs = [np.asarray(v.values) for v in batch.column(2)]
            dims = np.array([len(v) for v in vs])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                p[at] = project(unit(np.stack([vs[i] for i in at])), axes)
            cols = [pa.array(np.floor(p[:, d] / eps).astype(np.int64)) for d in range(LEAD)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, LEAD, dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int32)), *cols, flat], names=["node", "label", "v", "n", "dim", *[f"c{d}" for d in range(LEAD)], "p"])

    cells = ", ".join(f"c{d} long" for d in range(LEAD))
    placed = map_arrow(reps.select("node", "label", "v", "n"), place, f"node {id_type}, label {label_type}, v array<{width}>, n long, dim int, {cells}, p array<double>")
    order = ["label", "dim", *[f"c{d}" for d in range(LEAD)], "node"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            p = np.asarray(rows["p"].combine_chunks().values).reshape(-1, LEAD)
            v = np.asarray(rows["v"].combine_chunks().values).astype(kind)
            made += 1
            one = lambda x, t: pa.array([x], t)
            return pa.RecordBatch.from_arrays(
                [one((part << 32) | made, pa.int64()), rows["label"].combine_chunks().slice(0, 1), rows["dim"].combine_chunks().slice(0, 1), one(p.min(0).tolist(), pa.list_(pa.float64())), one(p.max(0).tolist(), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), rows["node"].combine_chunks()), one(np.asarray(rows["n"]).tolist(), pa.list_(pa.int64())), one(v.tobytes(), pa.binary())],
                names=["block", "label", "dim", "lo", "hi", "nodes", "ns", "vs"],
            )

        def ready(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            """Full blocks, and those that a new label or dimension closes; the rest waits."""
            keys = list(zip(rows["label"].to_pylist(), rows["dim"].to_pylist(), strict=True))
            out, start = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) and not last and i - start < BLOCK:
                    break
                if i == len(keys) or i - start == BLOCK or keys[i] != keys[start]:
                    out.append(block(rows.slice(start, i - start)))
                    start = i
            return out, rows.slice(start)

        rest = None
        for batch in batches:
            held = [batch] if rest is None or not rest.num_rows else [*rest.to_batches(), batch]
            done, rest = ready(pa.Table.from_batches(held), False)
            yield from done
        if rest is not None and rest.num_rows:
            yield from ready(rest, True)[0]

    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(map_arrow(ordered, cut, f"block long, label {label_type}, dim int, lo array<double>, hi array<double>, nodes array<{id_type}>, ns array<long>, vs binary"), "blocks")


def _near(a: str, b: str, eps2: float):
    gap = F.zip_with(F.zip_with(f"lo_{b}", f"hi_{a}", lambda x, y: x - y), F.zip_with(f"lo_{a}", f"hi_{b}", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps2


def _tiles(blocks: DataFrame, cosine: float) -> DataFrame:
    """``label, dim, a, b, grp, block``: which blocks a tile compares, those of its intervals ``a`` and ``b``.

    The B blocks of a label and dimension fall into intervals of about sqrt(B) blocks, at
    most ``TILE`` and ``TILE_BYTES``. Two intervals whose boxes are within reach of each other are a tile,
    one task's work, to which go their blocks that are within reach of the other
    interval. So a block goes to at most as many tasks as there are intervals, not to
    one per other block.
    """
    eps2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-9
    narrow = blocks.select("block", "label", "dim", F.shiftright("block", 32).alias("part"), "lo", "hi")
    # places in the label: those in the partition, and the blocks of the partitions before
    runs = narrow.groupBy("label", "dim", "part").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("label", "dim")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (F.col("dim") * 8 * BLOCK)))
    width = F.least(F.ceil(F.sqrt(F.sum("n").over(whole))), F.lit(TILE), most)
    runs = runs.select("label", "dim", "part", "first", before.alias("before"), width.alias("width"))
    placed = narrow.join(runs, ["label", "dim", "part"]).withColumn("grp", F.floor((F.col("block") - F.col("first") + F.col("before")) / F.col("width")).cast("int"))
    placed = settle(placed.select("label", "dim", "grp", "block", "lo", "hi"), "places")
    ends = lambda c, f: F.array(*[f(F.col(c)[d]) for d in range(LEAD)])
    boxes = placed.groupBy("label", "dim", "grp").agg(ends("lo", F.min).alias("lo"), ends("hi", F.max).alias("hi"))
    side = lambda s: boxes.select("label", "dim", F.col("grp").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    tiles = settle(side("a").join(side("b"), ["label", "dim"]).where((F.col("a") <= F.col("b")) & _near("a", "b", eps2)), "tiles")
    out = None
    own = placed.select("label", "dim", "grp", "block", F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"))
    for mine, other in (("a", "b"), ("b", "a")):
        reach = tiles if mine == "a" else tiles.where("a < b")
        sent = own.join(reach.withColumn("grp", F.col(mine)), ["label", "dim", "grp"]).where(_near("x", other, eps2)).select("label", "dim", "a", "b", "grp", "block")
        out = sent if out is None else out.union(sent)
    return settle(out, "sent")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Vectors of one label (and one number of components) link at a cosine of
    ``cosine`` or more, in double precision. Vectors that are null, empty, zero or
    hold null or non-finite components, and those without a label, link with nothing.
    Equal vectors of a label are one node with a weight, so copies are never paired.
    Each tile of two intervals gives link counts and a spanning forest, at most one row
    per vector, so a dense cluster does not give its pairs. Ids are taken as unique:
    rows that share one share component and links between them are counted like others.
    A null id links with nothing and is kept. Other columns are not read, so none can
    clash. An empty table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    width = kinds[vec_col][len("array<") : -1]
    if width not in ("float", "double"):
        raise ValueError(f"{vec_col} has to be an array of float or double")
    rows = settle(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")).withColumn("ok", usable() & F.col("id").isNotNull()), "vectors")
    ok = with_group(rows.where("ok").select("id", "label", "v"), ["label", "v"], {"rep": F.min("id")}, "id")
    members = settle(ok.select("id", F.coalesce("rep", "id").alias("node"), F.coalesce("group_n", F.lit(1)).cast("long").alias("n"), "label", "v"), "members")
    reps = members.where("id = node AND n = 1").union(members.where("id = node AND n > 1").dropDuplicates(["node", "label", "v"]))  # a repeated row is one
    sample = [np.array(r.v) for r in reps.orderBy(F.xxhash64("id")).limit(FIT_ROWS).select("v").collect()]
    axes = principal(sample)
    blocks = _blocks(reps, axes, kinds[id_col], kinds[label_col], width)
    sent = _tiles(blocks, cosine).join(blocks.select("block", "nodes", "ns", "vs"), "block")
    kind = np.float32 if width == "float" else np.float64

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        dim = t["dim"][0].as_py()

        def load(grp: int):
            rows = t.filter(pc.equal(t["grp"], grp))
            if not rows.num_rows:
                return None
            v = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows["vs"]]).reshape(-1, dim)
            return (v, project(unit(v), axes), rows["ns"].combine_chunks().flatten().to_numpy()), rows["nodes"].combine_chunks().flatten()

        a, b = t["a"][0].as_py(), t["b"][0].as_py()
        left = load(a)
        right = left if a == b else load(b)
        none = pa.array([], t.schema.field("nodes").type.value_type)
        if left is None or right is None:
            return pa.table([none, pa.array([], pa.int64()), none], names=["node", "cnt", "root"])
        out = IntervalJoin(left[0], right[0], cosine)
        ids = left[1] if a == b else pa.concat_arrays([left[1], right[1]])
        hit = np.flatnonzero(out.counts)
        return pa.table([ids.take(pa.array(hit)), pa.array(out.counts[hit]), ids.take(pa.array(out.comp[hit]))], names=["node", "cnt", "root"])

    found = settle(sent.groupBy("label", "dim", "a", "b").applyInArrow(join, f"node {kinds[id_col]}, cnt long, root {kinds[id_col]}"), "links")
    release(blocks)
    comps = connected_components(found, "node", "root")
    counts = found.groupBy("node").agg(F.sum("cnt").alias("cnt"))
    nodes = settle(counts.join(comps, "node", "left"), "nodes")
    linked = members.select("id", "node", "n").join(nodes, "node", "left").select("id", (F.col("n") - 1 + F.coalesce("cnt", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    none = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(none).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_epsilon_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
