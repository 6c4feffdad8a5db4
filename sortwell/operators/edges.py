"""Similarity joins within a label."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortwell.functions.vectors import bound
from sortwell.operators.match import same_join
from sortwell.operators.runs import by_group, groups_within, starts, whole_runs
from sortwell.operators.spread import with_group
from sortwell.session import map_arrow, settle

#: Positions in a block, blocks in a group or chunk of a mixed label, and rows that are compared with a side at a time.
BLOCK, TILE, AT_ONCE = 512, 32, 128
#: Blocks, and bytes, of a side of a tile at most; sides that a task holds, about; tasks for each core at least, where there are as many tiles.
SIDE, SIDE_BYTES, HELD, SHARE = 4, 2 << 20, 32, 16
#: Links that are put in order at a time; links in a list; lists in a batch.
SORTED, LIST, LISTS = 1 << 21, 4096, 16
#: Vectors of a label that a component may have to count as rare, so rows of a posting at most; what rounding may take off a bound.
POSTING, SLACK = 4096, 1e-9
#: Components other than zero, and tuples of them, of a vector that is sought by tuples; the share of a label that may be other vectors; pairs that are compared at a time.
NONZERO, TUPLES, OTHERS, PAIRS = 16, 64, 1 / 32, 1 << 14
TUPLE = ["label", "dim", "a", "b", "c"]
MAX_BITS = 3


def with_representative(items: DataFrame, value: str, key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, idx, value, rep``: ``rep`` is the smallest position of the label with an equal value.

    Values are told apart by two hashes of 64 bits with seeds of their own, so only
    hashes are grouped, and none of the values is shuffled for it but along with its row.
    """
    marked = items.select(key, idx, value, F.xxhash64(value).alias("_h1"), F.xxhash64(F.lit(1), F.col(value)).alias("_h2"))
    found = with_group(marked, [key, "_h1", "_h2"], {"rep": F.min(idx)}, idx)
    return found.select(key, idx, value, F.coalesce("rep", idx).alias("rep"))


def _copies(classes: DataFrame, key: str, idx: str, name: str, measure: Column) -> DataFrame:
    return classes.where(F.col(idx) != F.col("rep")).select(key, F.col("rep").alias("i"), F.col(idx).alias("j"), measure.alias(name), F.lit(True).alias("copy"))


def _orders(vectors: DataFrame) -> DataFrame:
    """``label, dim, comps, counts, rows``: the components of the vectors of a label and length, rarest first, how many vectors have them, and how many there are."""
    label_type = vectors.schema["label"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in groups_within(batch, ["label", "dim"]):
                n = (_matrix(t) != 0).sum(axis=0)
                c = np.append(np.flatnonzero(n), -1)  # no component: the vectors themselves
                n = np.append(n, t.num_rows)
                label = t["label"].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(c), np.int64)))
                yield pa.RecordBatch.from_arrays([label, pa.array(np.full(len(c), t["dim"][0].as_py(), np.int32)), pa.array(c.astype(np.int32)), pa.array(n[c].astype(np.int64))], names=["label", "dim", "c", "n"])

    found = map_arrow(vectors.select("label", "dim", "v"), count, f"label {label_type}, dim int, c int, n long").groupBy("label", "dim", "c").agg(F.sum("n").alias("n"))
    ordered = found.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.when(F.col("c") >= 0, F.struct("n", "c")))).alias("o"), F.max(F.when(F.col("c") < 0, F.col("n"))).alias("rows"))
    return ordered.select("label", "dim", F.col("o.c").alias("comps"), F.col("o.n").alias("counts"), "rows")


def scaled(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a group with one length, each times a power of two, and the squares of their lengths.

    Such a scale loses no bit, and keeps the squares from overflowing. Dots of whole numbers stay exact.
    """
    m = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, t["dim"][0].as_py())
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
    return m, (m * m).sum(axis=1)


def cosines(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices whose squared lengths are known: the dot over the root of both squares' product.

    One root of an exact product is exact where it can be, so that a cosine that equals a
    threshold is not taken for more.
    """
    sim = a @ b.T
    sim /= np.sqrt(np.outer(aa, bb))
    return sim


def _matrix(t: pa.Table) -> np.ndarray:
    """The vectors of a group with one length, each scaled to length one, for bounds."""
    m, mm = scaled(t)
    return m / np.sqrt(mm[:, None])


def _routed(vectors: DataFrame, threshold: float) -> DataFrame:
    """``vectors`` plus ``rare`` and ``light``.

    Components come in the order of rarity. A vector's prefix ends where the rest of it
    is shorter than ``threshold``: by the inequality of Cauchy and Schwarz two vectors
    over the threshold share a component of both prefixes. ``rare`` are the prefix's
    components that at most ``POSTING`` vectors of the label have, as long as the pairs in their
    postings are fewer than all pairs of the label; the vector is light
    if these are all of its prefix.
    """
    label_type = vectors.schema["label"].dataType.simpleString()
    rows = same_join(vectors, _orders(vectors), ["label", "dim"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in groups_within(batch, ["label", "dim"]):
                order, counts = np.array(t["comps"][0].as_py()), np.array(t["counts"][0].as_py())
                m = _matrix(t)[:, order]
                rest = np.sqrt(np.maximum(0.0, 1.0 - np.cumsum(m * m, axis=1)))
                ends = (rest >= threshold - SLACK).sum(axis=1)  # the last component of the prefix
                here = (m != 0) & (np.arange(len(order)) <= ends[:, None])
                few = (counts <= POSTING) & (np.cumsum(counts * counts) <= t["rows"][0].as_py() ** 2)
                rare = [pa.array(order[x].astype(np.int32)) for x in here & few]
                light = ~(here & ~few).any(axis=1)
                flat = pa.concat_arrays(rare) if rare else pa.array([], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32)), flat)
                b = t.combine_chunks()
                yield pa.RecordBatch.from_arrays([b[k].combine_chunks() for k in ("label", "dim", "idx", "v")] + [lists, pa.array(light)], names=["label", "dim", "idx", "v", "rare", "light"])

    return map_arrow(rows.select("label", "dim", "idx", "v", "comps", "counts", "rows"), route, f"label {label_type}, dim int, idx long, v array<double>, rare array<int>, light boolean")


def _earlier(t: pa.Table) -> np.ndarray:
    """A row per row of a posting: 1 for each component that it lists before the posting's own one."""
    lists, own = t["rare"].combine_chunks(), t["posting"][0].as_py()
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    until = np.zeros(len(sizes), np.int64)
    mine = flat == own
    until[row[mine]] = place[mine]
    before = place < until[row]
    names, at = np.unique(flat[before], return_inverse=True)
    out = np.zeros((len(sizes), len(names)), np.float32)
    out[row[before], at] = 1
    return out


def _postings(routed: DataFrame) -> DataFrame:
    """``label, dim, posting, idx, v, rare, light``: each vector for every posting of a rare component in which it is compared."""
    return routed.select("label", "dim", "idx", "v", "rare", "light", F.explode("rare").alias("posting"))


def _sides(routed: DataFrame) -> tuple[DataFrame, int]:
    """``label, dim, side, sides, idx, v`` of the vectors that are not light, and how many sides there are in labels of more than one.

    A side is an interval of positions, and ``sides`` how many the label has.
    """
    width = F.least(F.lit(BLOCK * SIDE), F.greatest(F.lit(1), F.floor(F.lit(SIDE_BYTES // 8) / F.col("dim"))))
    rows = routed.where("NOT light").select("label", "dim", F.floor(F.col("idx") / width).cast("long").alias("side"), "idx", "v")
    counts = settle(rows.groupBy("label", "dim").agg(F.count_distinct("side").alias("sides")), "sides")
    return same_join(rows, counts, ["label", "dim"]).select("label", "dim", "side", "sides", "idx", "v"), counts.where("sides > 1").agg(F.sum("sides")).first()[0] or 0


def _links(label: pa.Array, at: np.ndarray, m: np.ndarray, mm: np.ndarray, to: np.ndarray, others: np.ndarray, squares: np.ndarray, threshold: float, only: Callable[[slice], np.ndarray] | None) -> Iterator[tuple]:
    """The label, and ``i, j, sim`` over the threshold between vectors at ``at`` and at ``to``; ``only`` says which pairs of some of the rows count."""
    for start in range(0, len(at), AT_ONCE):
        mine = slice(start, start + AT_ONCE)
        sim = cosines(m[mine], mm[mine], others, squares)
        link = sim > threshold
        if only is not None:
            link &= only(mine)
        if len(where := np.flatnonzero(link)):
            n = link.sum(axis=1)
            yield label, np.repeat(at[mine], n), to[where - np.repeat(np.arange(len(n)) * len(to), n)], np.minimum(sim.ravel()[where], 1.0)


def _listed(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """``label, links`` of what ``_links`` finds, in order of cosine, ``SORTED`` links or a few more at a time.

    Links are so many that they take the disk of whoever writes them. Cosines that are all different to the eye of a
    file's encoding take 8 bytes each; in order, those that round to the same are neighbours and take next to none.
    """
    held, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        i, j, sim = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        order = np.argsort(sim)
        for start in range(0, n, LIST * LISTS):
            at = order[start : start + LIST * LISTS]
            ends = np.append(np.arange(0, len(at), LIST), len(at)).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x[at]) for x in (i, j, sim)], names=["i", "j", "sim"]))
            yield pa.RecordBatch.from_arrays([held[0][0].take(pa.array(np.zeros(len(links), np.int64))), links], names=["label", "links"])

    for x in found:
        if held and (n >= SORTED or not x[0].equals(held[0][0])):
            yield from flush()
            held, n = [], 0
        held.append(x)
        n += len(x[1])
    if held:
        yield from flush()


def _tiled(routed: DataFrame, threshold: float, schema: str) -> DataFrame:
    """Links of vectors that are not light, with each other.

    A side is compared with itself where it was dealt. Sides of a label with more are packed, one row each, dealt once,
    and meet in a Cartesian product of partitions: a task for each pair of partitions reads both from what
    was dealt, so that no vector is written for each of the tiles that it is in.
    """
    sides, n = _sides(routed)
    label_type, keys = sides.schema["label"].dataType.simpleString(), ["label", "dim", "side"]
    dealt = sides.repartition(*keys).sortWithinPartitions(*keys, "idx")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in by_group(batches, keys):
            at, (m, mm) = t["idx"].to_numpy(), scaled(t)
            yield from _links(t["label"].combine_chunks().slice(0, 1), at, m, mm, at, m, mm, threshold, lambda mine, at=at: at[mine][:, None] < at)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, keys):
            if t["sides"][0].as_py() > 1:
                m, mm = scaled(t)
                whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (t["idx"].to_numpy(), mm, m.ravel())]
                yield pa.RecordBatch.from_arrays([*(t[k].combine_chunks().slice(0, 1) for k in keys), *whole], names=[*keys, "at", "mm", "m"])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in range(batch.num_rows):
                at, mm, m, to, squares, others = (batch[k][r].values.to_numpy() for k in ("at", "mm", "m", "at2", "mm2", "m2"))
                yield from _links(batch["label"].slice(r, 1), at, m.reshape(len(at), -1), mm, to, others.reshape(len(to), -1), squares, threshold, None)

    found = map_arrow(dealt, lambda batches: _listed(within(batches)), schema)
    if not n:
        return found
    # not written as Parquet, whose reader takes thousands of rows at a time
    packed = map_arrow(dealt, pack, f"label {label_type}, dim int, side long, at array<long>, mm array<double>, m array<double>")
    left = packed.repartition(math.ceil(max(n / HELD, min(n, math.sqrt(SHARE * routed.sparkSession.sparkContext.defaultParallelism)))))
    right = left.select(*[F.col(c).alias(f"{c}2") for c in left.columns])
    on = F.col("label").eqNullSafe(F.col("label2")) & (F.col("dim") == F.col("dim2")) & (F.col("side") < F.col("side2"))
    tiles = left.hint("shuffle_replicate_nl").join(right, on).select("label", "at", "mm", "m", "at2", "mm2", "m2")
    return found.union(map_arrow(tiles, lambda batches: _listed(cross(batches)), schema))


def vector_classes(items: DataFrame, vec: str, key: str, idx: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (see ``with_representative``), and the first of each with its length ``dim``."""
    some = F.exists(vec, lambda x: x != 0)
    usable = items.where(some).select(F.col(key).alias("label"), F.col(idx).cast("long").alias("idx"), F.col(vec).cast("array<double>").alias("v"))
    classes = settle(with_representative(usable, "v", "label", "idx"), "classes")
    return classes, classes.where("idx = rep").select("label", F.size("v").alias("dim"), "idx", "v")


def _tupled(firsts: DataFrame, threshold: float) -> DataFrame:
    """``label, dim, idx, a, b, c, comps, vals, heavy``: a row for each tuple of components by which a sparse vector is sought.

    Components come in the order of rarity. Two vectors over the threshold share components that
    make up ``threshold`` of the length of each (Cauchy and Schwarz). If these are three or more, the
    first three are a tuple ``a, b, c`` of both: what of a vector is in the first two and from the
    third on is not shorter than that. If they are fewer, they are all of a tuple that long, with -1 for
    the rest. A vector with more than ``NONZERO`` components or ``TUPLES`` tuples is heavy and has one row without.
    """
    label_type = firsts.schema["label"].dataType.simpleString()
    v, dim = F.col("v"), F.col("dim")
    cells = F.transform(F.filter(F.sequence(F.lit(0), dim - 1), lambda i: F.get(v, i) != 0), lambda i: F.struct(i.alias("i"), F.get(v, i).alias("x")))
    # written, so that the cells of a row are taken once
    rows = settle(firsts.select("label", "dim", "idx", bound(cells, lambda x: F.when(F.size(x) <= NONZERO, x)).alias("cells")), "cells")
    rows = rows.select("label", "dim", "idx", F.col("cells.i").alias("comps"), F.col("cells.x").alias("vals"))
    counts = rows.where("comps IS NOT NULL").select("label", "dim", F.explode("comps").alias("comp")).groupBy("label", "dim", "comp").agg(F.count(F.lit(1)).alias("n"))
    known = counts.groupBy("label", "dim").agg(F.map_from_entries(F.collect_list(F.struct("comp", "n"))).alias("m"))
    known = known.select("label", "dim", F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("counts"))
    rated = same_join(rows, known, ["label", "dim"], "left").select("label", "dim", "idx", "comps", "vals", F.transform("comps", lambda i: F.get("counts", i)).alias("n"))
    need = threshold * threshold - SLACK

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["comps"].value_lengths().fill_null(0).to_numpy()
            offset, flat = np.cumsum(size) - size, [batch[k].flatten().to_numpy() for k in ("comps", "vals", "n")]
            heavy = size == 0
            out = []  # row, tuple, its components and their values
            for k in np.unique(size[~heavy]).tolist():
                row = np.flatnonzero(size == k)
                c, x, n = (f[offset[row][:, None] + np.arange(k)] for f in flat)
                order = np.lexsort((c, n), axis=1)
                c, x = np.take_along_axis(c, order, 1), np.take_along_axis(x, order, 1)
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                q = x * x / (x * x).sum(axis=1, keepdims=True)
                rest = np.cumsum(q[:, ::-1], axis=1)[:, ::-1]
                at, picked = [], []
                for m in (1, 2, 3):
                    for pick in combinations(range(k), m):
                        mass = q[:, list(pick)].sum(axis=1) if m < 3 else q[:, pick[0]] + q[:, pick[1]] + rest[:, pick[2]]
                        r = np.flatnonzero(mass >= need)
                        at.append(r)
                        picked.append(np.stack([*(c[r, p] for p in pick), *[np.full(len(r), -1)] * (3 - m)], axis=1))
                at, picked = np.concatenate(at), np.concatenate(picked)
                many = np.bincount(at, minlength=len(row)) > TUPLES
                heavy[row[many]] = True
                keep = ~many[at]
                out.append((row[at[keep]], picked[keep], c[at[keep]], x[at[keep]]))
            others = np.flatnonzero(heavy)
            for row, picked, c, x in [*out, (others, np.full((len(others), 3), -1), np.zeros((len(others), 0), int), np.zeros((len(others), 0)))]:
                lists = lambda m, kind: pa.ListArray.from_arrays(pa.array((np.arange(len(m) + 1) * m.shape[1]).astype(np.int32)), pa.array(m.ravel().astype(kind)))
                own = [batch[k].take(pa.array(row)) for k in ("label", "dim", "idx")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(picked[:, k].astype(np.int32)) for k in range(3)), lists(c, np.int32), lists(x, np.float64), pa.array(heavy[row])], names=[*("label", "dim", "idx", "a", "b", "c", "comps", "vals", "heavy")])

    return map_arrow(rated, tuples, f"label {label_type}, dim int, idx long, a int, b int, c int, comps array<int>, vals array<double>, heavy boolean")


def _routes(firsts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``_tupled`` of labels that are sought by tuples, the vectors of these labels with ``heavy``, and the vectors of the other labels.

    A vector is also heavy if more than ``POSTING`` vectors have one of its tuples. A label (and
    length) with a larger share of heavy vectors than ``OTHERS`` is not sought by tuples.
    """
    tupled = settle(_tupled(firsts, threshold), "tuples")
    hot = tupled.where("NOT heavy").groupBy(*TUPLE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > POSTING).drop("n")
    many = same_join(tupled.where("NOT heavy"), hot, TUPLE, "left_semi").select("label", "dim", "idx").distinct()
    heavy = settle(tupled.where("heavy").select("label", "dim", "idx").union(many), "heavy")
    n = F.count(F.lit(1))
    sizes = same_join(firsts.groupBy("label", "dim").agg(n.alias("rows")), heavy.groupBy("label", "dim").agg(n.alias("heavies")), ["label", "dim"], "left").na.fill(0, ["heavies"])
    sparse = settle(sizes.where(F.col("heavies") <= F.col("rows") * OTHERS), "sparse")
    meeting = same_join(same_join(tupled.where("NOT heavy"), sparse, ["label", "dim"], "left_semi"), heavy, ["label", "dim", "idx"], "left_anti").drop("heavy")
    here = same_join(firsts, sparse.where("heavies > 0"), ["label", "dim"])
    here = same_join(here, heavy.withColumn("heavy", F.lit(True)), ["label", "dim", "idx"], "left").na.fill(False, ["heavy"])
    return meeting, here, same_join(firsts, sparse, ["label", "dim"], "left_anti")


def _met(meeting: DataFrame, threshold: float, label_type: str) -> DataFrame:
    """Links of vectors that share a tuple; a pair is given by the first components that it shares."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches, TUPLE):
            run, at, n = np.cumsum(starts(b, TUPLE, None)), b["idx"].to_numpy(), b.num_rows
            size = b["comps"].value_lengths().to_numpy()
            comps, vals = np.full((n, size.max()), -1), np.zeros((n, size.max()))
            here = np.arange(size.max()) < size[:, None]
            comps[here], vals[here] = b["comps"].flatten().to_numpy(), b["vals"].flatten().to_numpy()
            squares, own = (vals * vals).sum(axis=1), np.stack([b[k].to_numpy() for k in "abc"], axis=1)
            far = 1
            while far < n and len(left := np.flatnonzero(run[:-far] == run[far:])):
                for x in np.split(left, range(PAIRS, len(left), PAIRS)):
                    y = x + far
                    same = (comps[x][:, :, None] == comps[y][:, None, :]) & here[x][:, :, None]
                    shared = same.any(axis=2)
                    dot = (vals[x] * (same * vals[y][:, None, :]).sum(axis=2)).sum(axis=1)
                    sim = np.minimum(dot / np.sqrt(squares[x] * squares[y]), 1.0)
                    nth = np.cumsum(shared, axis=1)
                    first = np.stack([np.where(shared & (nth == k), comps[x], -1).max(axis=1) for k in (1, 2, 3)], axis=1)
                    once = (sim > threshold) & (first == own[x]).all(axis=1)
                    if once.any():
                        yield pa.RecordBatch.from_arrays([b["label"].take(pa.array(x[once])), pa.array(at[x[once]]), pa.array(at[y[once]]), pa.array(sim[once])], names=["label", "i", "j", "sim"])
                far += 1

    return map_arrow(meeting.repartition(*TUPLE).sortWithinPartitions(*TUPLE, "idx"), meet, f"label {label_type}, i long, j long, sim double")


def _crossed(here: DataFrame, threshold: float, label_type: str) -> DataFrame:
    """Links of heavy vectors, dealt to groups, with all vectors of their label, dealt to chunks; each pair of a group and a chunk is a tile."""
    size, n = BLOCK * TILE, F.count(F.lit(1))
    sizes = here.groupBy("label", "dim").agg(F.ceil(n / size).cast("int").alias("chunks"), F.ceil(F.count_if("heavy") / size).cast("int").alias("parts"))
    rows = same_join(here.select("label", "dim", "idx", "v", "heavy"), sizes, ["label", "dim"])
    own = lambda ways: F.pmod(F.xxhash64("idx"), F.col(ways)).cast("int")
    upto = lambda ways: F.explode(F.sequence(F.lit(0), F.col(ways) - 1))
    cols, keys = ("label", "dim", "part", "chunk", "left", "idx", "v", "heavy"), ["label", "dim", "part", "chunk"]
    lefts = rows.where("heavy").withColumns({"part": own("parts"), "left": F.lit(True)}).withColumn("chunk", upto("chunks"))
    rights = rows.withColumns({"chunk": own("chunks"), "left": F.lit(False)}).withColumn("part", upto("parts"))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, keys):
            at, (m, mm), left, heavy, label = t["idx"].to_numpy(), scaled(t), t["left"].to_numpy(), t["heavy"].to_numpy(), t["label"].combine_chunks().slice(0, 1)
            mine, others = np.flatnonzero(left), np.flatnonzero(~left)
            for start in range(0, len(mine), AT_ONCE):
                rows = mine[start : start + AT_ONCE]
                sim = cosines(m[rows], mm[rows], m[others], mm[others])
                x, y = np.nonzero(sim > threshold)
                i, j = at[rows[x]], at[others[y]]
                once = np.where(heavy[others[y]], i < j, True)
                i, j, s = i[once], j[once], np.minimum(sim[x, y][once], 1.0)
                yield pa.RecordBatch.from_arrays([label.take(pa.array(np.zeros(len(i), np.int64))), pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(s)], names=["label", "i", "j", "sim"])

    both = lefts.select(*cols).union(rights.select(*cols))
    return map_arrow(both.repartition(*keys).sortWithinPartitions(*keys), cross, f"label {label_type}, i long, j long, sim double")


def cosine_edges(items: DataFrame, threshold: float, vec: str = "v", key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, i, j, sim, copy`` for ``i < j`` of one label with a cosine over ``threshold``, above 0.

    Equal vectors are one class: links are those between the classes' smallest
    positions (``copy`` is false), and of each class from that position to the others
    (``copy`` is true), so copies are never paired and no link between different
    vectors is lost. Null and zero vectors link with nothing, nor do vectors of
    different lengths; a null label is a label.

    Vectors of few components are sought by the first three that a pair shares (see ``_tupled``), and
    the few others of their label are compared with all of it.
    Vectors of other labels are sought by prefix filtering (see ``_routed``): a vector goes to
    the postings of its prefix's rare components, at most ``POSTING`` rows each,
    however large the label is, and a pair is given by the first such component that it
    shares. Only vectors whose prefix has a component that many others have are
    compared with each other in tiles (see ``_tiled``): their positions fall into intervals of
    ``SIDE`` blocks at most, each pair of intervals is one tile, and a vector is dealt once,
    however many tiles it is in. Both ways are exact, and every pair is met in one of them.
    ``idx`` has to be a position in the label (see ``with_position``).
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed")
    label_type = items.schema[key].dataType.simpleString()
    classes, firsts = vector_classes(items, vec, key, idx)
    meeting, mixed, dense = _routes(firsts, threshold)
    routed = settle(_routed(dense, threshold), "routed")
    keys = ["label", "dim", "posting"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for t in by_group(batches, keys):
            at, (m, mm), light, before = t["idx"].to_numpy(), scaled(t), t["light"].to_numpy(), _earlier(t)
            # each pair shows twice; an earlier posting of both, or a tile, may have it
            only = lambda mine, at=at, light=light, before=before: (at[mine][:, None] < at) & (before[mine] @ before.T == 0) & (light[mine][:, None] | light)
            yield from _links(t["label"].combine_chunks().slice(0, 1), at, m, mm, at, m, mm, threshold, only)

    # links come from Python as lists, since rows cost more than what they hold
    schema = f"label {label_type}, links array<struct<i: long, j: long, sim: double>>"
    met = map_arrow(_postings(routed).repartition(*keys).sortWithinPartitions(*keys), lambda batches: _listed(compare(batches)), schema)
    found = met.union(_tiled(routed, threshold, schema)).select("label", F.inline("links"))
    found = found.union(_met(meeting, threshold, label_type)).union(_crossed(mixed, threshold, label_type))
    links = found.withColumn("copy", F.lit(False)).unionByName(_copies(classes, "label", "idx", "sim", F.lit(1.0)))
    return links.withColumnRenamed("label", key)


def cosine_candidates(items: DataFrame, threshold: float, vec: str = "v", key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, vectors, light, sent, compared``: different vectors of a label, how many are light, rows dealt, and pairs that ``cosine_edges`` compares at most."""
    _, firsts = vector_classes(items, vec, key, idx)
    meeting, mixed, dense = _routes(firsts, threshold)
    routed = settle(_routed(dense, threshold), "routed")
    n, lights = F.count(F.lit(1)), F.count_if("light")
    pairs = (n * (n - 1) - (n - lights) * (n - lights - 1)) / 2
    groups = _postings(routed).groupBy("label", "dim", "posting").agg(n.alias("rows"), pairs.cast("long").alias("pairs")).select("label", "rows", "pairs")
    sides, _ = _sides(routed)
    tiles = sides.groupBy("label", "dim").agg((n * F.when(F.max("sides") > 1, 2).otherwise(1)).alias("rows"), (n * (n - 1) / 2).cast("long").alias("pairs")).select("label", "rows", "pairs")
    tuples = meeting.groupBy(*TUPLE).agg(n.alias("rows"), (n * (n - 1) / 2).cast("long").alias("pairs")).select("label", "rows", "pairs")
    heavies, size = F.count_if("heavy"), BLOCK * TILE
    crossed = mixed.groupBy("label", "dim").agg((n * F.ceil(heavies / size) + heavies * F.ceil(n / size)).alias("rows"), (n * heavies).alias("pairs")).select("label", "rows", "pairs")
    per = groups.union(tiles).union(tuples).union(crossed).groupBy("label").agg(F.sum("rows").alias("sent"), F.sum("pairs").alias("compared"))
    heavy = routed.where("NOT light").select("label").union(mixed.where("heavy").select("label")).groupBy("label").agg(n.alias("heavy"))
    counts = same_join(same_join(firsts.groupBy("label").agg(n.alias("vectors")), per, ["label"]), heavy, ["label"], "left")
    return counts.select(F.col("label").alias(key), "vectors", (F.col("vectors") - F.coalesce("heavy", F.lit(0))).alias("light"), "sent", "compared")


def hamming_edges(items: DataFrame, max_bits: int = MAX_BITS, bits: str = "phash", key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, i, j, bits, copy`` for ``i < j`` of one label whose 64-bit hashes differ in at most ``max_bits``.

    Equal hashes are one class, linked as in ``cosine_edges``. A hash is cut into so few
    segments that one of them has at most one of ``max_bits`` differing bits; each
    looks up its own value and, of the values one bit away, those with a bit more,
    so a pair is met from one side. It is kept at its first such segment only, which
    spares a distinct. Other strings than 64 bits link with nothing; a null label is a label.
    """
    n = max_bits // 2 + 1
    cut = [round(64 * k / n) for k in range(n + 1)]
    size = [b - a for a, b in zip(cut, cut[1:], strict=False)]
    half = lambda s: F.conv(F.substring(bits, 32 * s + 1, 32), 2, 10).cast("long")
    whole = F.shiftleft(half(0), 32).bitwiseOR(half(1))
    rows = items.where(F.length(bits) == 64).select(F.col(key).alias("label"), F.col(idx).alias("idx"), whole.alias("h"))
    classes = with_representative(rows, "h", "label", "idx")
    segment = lambda h, k: F.shiftrightunsigned(h, 64 - cut[k + 1]).bitwiseAND(F.lit((1 << size[k]) - 1)) if size[k] < 64 else h
    segments = F.array(*[F.struct(F.lit(k).alias("k"), segment(F.col("h"), k).alias("seg")) for k in range(n)])
    table = classes.where("idx = rep").select("label", "idx", "h", F.inline(segments))
    width = F.element_at(F.array(*[F.lit(s) for s in size]), F.col("k") + 1)
    more = F.transform(F.sequence(F.lit(0), F.least(width, F.lit(63)) - 1), lambda i: F.when(F.call_function("getbit", F.col("seg"), i) == 0, F.col("seg").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    probes = table.select(F.col("label").alias("l2"), F.col("idx").alias("idx2"), F.col("h").alias("h2"), F.col("k").alias("k2"), F.col("seg").alias("from"), F.explode(F.concat(F.array("seg"), F.array_compact(more))).alias("at"))
    xor = F.col("h").bitwiseXOR(F.col("h2"))
    differ = F.bit_count(xor)
    earlier = F.lit(False)
    for k in range(n - 1):
        earlier = earlier | ((F.col("k") > k) & (F.bit_count(segment(xor, k)) <= 1))
    on = F.col("label").eqNullSafe(F.col("l2")) & (F.col("k") == F.col("k2")) & (F.col("seg") == F.col("at")) & ((F.col("at") != F.col("from")) | (F.col("idx2") < F.col("idx")))
    found = probes.join(table, on & (differ <= max_bits) & ~earlier).select("label", F.least("idx", "idx2").alias("i"), F.greatest("idx", "idx2").alias("j"), differ.cast("int").alias("bits"), F.lit(False).alias("copy"))
    return found.unionByName(_copies(classes, "label", "idx", "bits", F.lit(0))).withColumnRenamed("label", key)
