"""Train and test splits of each label that keep groups on one side."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortwell.operators.index import with_position
from sortwell.operators.match import same_join
from sortwell.session import settle

#: Deviation of the train share over which a group is moved.
OFF_TARGET = 0.05
#: Places in which stretches of equal groups are sought at a time.
STRETCH = 1 << 16


def _side(s: int, room_train: int, room_test: int) -> str:
    return "train" if room_test < s or room_train >= max(s, room_test) else "test"


def _segments(runs: Iterable[tuple[int, int, int, int]], n: int, n_train: int) -> Iterator[tuple[int, int, int, str, str]]:
    """Sides of runs of groups ``start, count, size, fresh``, as ``start, first, last, even, odd``: of the places from ``first`` to ``last`` in a run every other one.

    A group goes to train if that has the larger room and holds it, or if test can't
    hold it, else to test; nothing is dealt without room. ``size`` decides, ``fresh`` is
    how many of its rows no earlier group holds and is what fills a side. Groups of one
    run go to a side until its room meets a bound, or to both in turn while their
    rooms differ by less than a group, so a run takes a few steps however long it is.
    """
    room = {"train": n_train, "test": n - n_train}
    for start, count, s, f in runs:
        at = 0
        while at < count and sum(room.values()) > 0:
            side = _side(s, room["train"], room["test"])
            left = count - at
            if f == 0 or room["test"] < s:  # nothing changes, or all room is train's
                steps = left
            elif side == "train":
                steps = (room["train"] - max(s, room["test"])) // f + 1
            else:  # until test is too small, or train has the larger room
                steps = (room["test"] - s) // f + 1
                if room["train"] >= s:
                    steps = min(steps, -(-(room["test"] - room["train"]) // f))
            if f:
                steps = min(steps, left, -(-sum(room.values()) // f))
            if steps == 1 and f and side == "train" and room["test"] >= s and _side(s, room["train"] - f, room["test"]) == "test":
                turns = min((room["train"] - max(s, 0)) // f + 1, (room["test"] - s) // f + 1, left // 2) if _side(s, room["train"] - f, room["test"] - f) == "train" else 0
                if turns > 1:
                    room["train"] -= turns * f
                    room["test"] -= turns * f
                    yield start, at, at + 2 * turns, "train", "test"
                    at += 2 * turns
                    continue
            room[side] -= steps * f
            yield start, at, at + steps, side, side
            at += steps


def group_sides(items: DataFrame, groups: DataFrame, ratio: float, key: str = "label", rebalance: bool = True) -> DataFrame:
    """``key, group_no, split, moved_to``: groups ``key, group_no, idx`` by falling size, then by number, dealt to the sides.

    Each decision depends on all before it, but only on what room is left, so groups of
    one size are decided as a run (see ``_segments``). A label's fold holds a row per
    size; of a size whose groups overlap others to different extents, one per stretch
    of equal groups. Groups get their places by ranges, and their sides by a lookup
    of the run. At most one group is moved afterwards, the smallest that brings
    the train share closer, if it is off by more than ``OFF_TARGET``.
    """
    kind = items.schema[key].dataType.simpleString()
    flat = groups.select(F.col(key).alias("k"), "group_no", "idx")
    sized = same_join(flat, flat.groupBy("k", "group_no").agg(F.count(F.lit(1)).alias("size")), ["k", "group_no"])
    order = F.struct((-F.col("size")).alias("s"), F.col("group_no").alias("g"))
    owner = sized.groupBy("k", "idx").agg(F.min(order).alias("o"))
    per_group = same_join(sized, owner, ["k", "idx"])
    rows = per_group.groupBy("k", "group_no", "size").agg(F.sum((F.col("o.g") == F.col("group_no")).cast("long")).alias("fresh"), F.min_by("o", "idx")["g"].alias("head"))
    placed = with_position(settle(rows, "sizes"), "k", [F.col("size").desc(), F.col("group_no").asc()], "place")
    n = items.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("n_train", F.floor(F.col("n") * F.lit(float(ratio)).cast("double")))

    sizes = placed.groupBy("k", "size").agg(F.min("place").alias("start"), (F.min("fresh") < F.max("fresh")).alias("mixed"))
    known = same_join(placed, sizes, ["k", "size"])
    along = Window.partitionBy("k", "size", F.floor(F.col("place") / STRETCH)).orderBy("place")
    other = F.coalesce(F.lag("fresh").over(along) != F.col("fresh"), F.lit(True))
    mixed = known.where("mixed").withColumn("begins", F.when(other, F.col("place"))).withColumn("start", F.last("begins", ignorenulls=True).over(along)).drop("begins")
    known = settle(known.where("NOT mixed").unionByName(mixed).drop("mixed"), "runs")
    runs = same_join(known.groupBy("k", "start", "size", "fresh").agg(F.count(F.lit(1)).alias("count")), n, ["k"])

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        found = list(_segments(zip(*(t[c].to_pylist() for c in ("start", "count", "size", "fresh")), strict=True), t["n"][0].as_py(), t["n_train"][0].as_py()))
        cols = list(zip(*found, strict=True)) or [[]] * 5
        return pa.table({"k": t["k"].combine_chunks().slice(0, 1).take(pa.array([0] * len(found), pa.int64())), **{c: pa.array(v, kind) for c, v, kind in zip(("start", "first", "last", "even", "odd"), cols, (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True)}})

    segments = settle(runs.groupBy("k").applyInArrow(fold, f"k {kind}, start long, first long, last long, even string, odd string"), "segments")
    nth = F.col("place") - F.col("start")
    turn = F.when((nth - F.col("first")) % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    sides = same_join(known, segments, ["k", "start"], "left").withColumn("split", F.when((nth >= F.col("first")) & (nth < F.col("last")), turn))
    sides = settle(sides.groupBy("k", "group_no", "size", "fresh", "head", "place").agg(F.max("split").alias("split")), "sides")
    if not rebalance:
        return sides.select(F.col("k").alias(key), "group_no", "split", F.lit(None).cast("string").alias("moved_to"))
    filled = lambda side: F.coalesce(F.sum(F.when(F.col("split") == side, F.col("fresh"))), F.lit(0))
    used = same_join(sides.groupBy("k").agg(filled("train").alias("train"), filled("test").alias("test")), n, ["k"])
    train = F.col("train") + F.least(F.greatest(F.col("n_train") - F.col("train"), F.lit(0)), F.col("n") - F.col("train") - F.col("test"))
    away = lambda x: F.abs(x / F.col("n") - F.lit(float(ratio)))
    used = used.withColumn("train", train).withColumn("off", away(F.col("train"))).where(F.col("off") > OFF_TARGET).select("k", "train", "off", "n", "n_train")
    heads = sides.select("k", F.col("group_no").alias("head"), F.col("split").alias("of_head"))
    near = same_join(same_join(sides.where("split IS NOT NULL"), used, ["k"]).where("size <= abs(train - n_train)"), heads, ["k", "head"])
    step = F.when(F.coalesce(F.col("of_head") == "train", F.lit(False)), -F.col("size")).otherwise(F.col("size"))
    fits = near.withColumn("step", step).where(((F.col("step") < 0) == (F.col("train") > F.col("n_train"))) & (away(F.col("train") + F.col("step")) < F.col("off")))
    moved = fits.groupBy("k").agg(F.min_by(F.struct("group_no", F.when(F.col("step") < 0, "test").otherwise("train").alias("to")), F.struct("size", "place")).alias("m")).select("k", "m.group_no", F.col("m.to").alias("moved_to"))
    return same_join(sides, moved, ["k", "group_no"], "left").select(F.col("k").alias(key), "group_no", "split", "moved_to")


def smart_split(items: DataFrame, groups: DataFrame, ratio: float, *, content: str | None = None, simple_to_test: float = 0.6, detailed_to_train: float = 0.7, rebalance: bool = True, key: str = "label", idx: str = "idx", quality: str = "quality") -> DataFrame:
    """``items`` plus ``split``.

    Groups go first, whole; other rows by falling quality fill the train side and
    then the test side. ``content="compat"`` deals the other rows as the original
    does (all of them simple, the best ones to test up to a quota);
    ``content="intended"`` deals rows of content_type complex by completeness and the
    others by complexity_score (columns of ``items``). Ranks are taken by
    ``with_position``, so a label is never ordered in one task. ``groups`` are rows
    ``key, group_no, idx``; a null label is a label.
    """
    sides = settle(group_sides(items, groups, ratio, key, rebalance), "sides")
    sizes = groups.groupBy(key, "group_no").agg(F.count(F.lit(1)).alias("_size"))
    dealt = same_join(sides.where("split IS NOT NULL"), sizes, [key, "group_no"])
    flat = same_join(groups.select(key, "group_no", F.col("idx").alias(idx)), dealt, [key, "group_no"])
    order = F.struct((-F.col("_size")).alias("s"), F.col("group_no").alias("g"))
    taken = flat.groupBy(key, idx).agg(F.min_by("split", order).alias("_first"), F.max("moved_to").alias("_moved"))
    rows = settle(same_join(items, taken, [key, idx], "left"), "grouped")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum((F.col("_first") == s).cast("long")).alias(f"_{s}") for s in ("train", "test")]).na.fill(0)
    train_n = F.floor(F.col("_n") * F.lit(float(ratio)).cast("double"))
    counts = counts.withColumn("_nt", train_n)
    free = rows.where("_first IS NULL").drop("_first", "_moved")
    if content is None:
        ranked = same_join(with_position(free, key, [F.col(quality).desc(), F.col(idx).asc()], "_r"), counts, [key])
        split = F.when(F.col("_r") < F.col("_nt") - F.col("_train"), "train").otherwise("test")
    elif content == "compat":
        ranked = same_join(with_position(free, key, [F.col(quality).desc(), F.col(idx).asc()], "_r"), counts, [key])
        u = F.col("_n") - F.col("_train") - F.col("_test")
        split = _simple_side(u, F.col("_test"), simple_to_test)
    else:
        detailed = F.coalesce(F.col("content_type") == "complex", F.lit(False))
        score = F.when(detailed, -F.coalesce("completeness_score", F.lit(0.5))).otherwise(F.coalesce("complexity_score", F.lit(0.5)))
        typed = free.withColumn("_kind", F.struct(F.col(key).alias("k"), detailed.alias("d"))).withColumn("_score", score)
        per = typed.groupBy(key).agg(F.sum(F.col("_kind.d").cast("long")).alias("_d"), F.sum((~F.col("_kind.d")).cast("long")).alias("_s"))
        ranked = same_join(same_join(with_position(typed, "_kind", [F.col("_score").asc(), F.col(quality).desc(), F.col(idx).asc()], "_r"), counts, [key]), per, [key])
        room = F.col("_nt") - F.col("_train")
        to_train = F.greatest(F.lit(0), F.least(F.floor(F.col("_d") * F.lit(float(detailed_to_train))), room))
        split = F.when(F.col("_kind.d"), F.when(F.col("_r") < to_train, "train").otherwise("test")).otherwise(_simple_side(F.col("_s"), F.col("_test") + F.col("_d") - to_train, simple_to_test))
    dealt = ranked.withColumn("split", split).select(*items.columns, "split")
    held = rows.where("_first IS NOT NULL").withColumn("split", F.coalesce("_moved", "_first")).select(*items.columns, "split")
    return dealt.unionByName(held)


def _simple_side(n: Column, in_test: Column, share: float) -> Column:
    """Of ``n`` simple rows by rank ``_r``, the first ones up to a quota go to test while it has room, all others to train."""
    room = F.col("_n") - F.col("_nt")
    quota = F.least(n, F.floor(n * F.lit(float(share))), in_test + n - room)
    return F.when((F.col("_r") < quota) & (in_test + F.col("_r") < room), "test").otherwise("train")


def split_by_quality(items: DataFrame, ratio: float, key: str = "label", idx: str = "idx", quality: str = "quality") -> DataFrame:
    """``items`` plus ``split``: a label's first rows by falling quality, as many as ``ratio`` of them rounded down, are train."""
    ranked = with_position(items, key, [F.col(quality).desc(), F.col(idx).asc()], "_r")
    n = items.groupBy(F.col(key).alias("_k")).agg(F.floor(F.count(F.lit(1)) * F.lit(float(ratio)).cast("double")).alias("_nt"))
    return ranked.join(n, F.col(key).eqNullSafe(F.col("_k"))).withColumn("split", F.when(F.col("_r") < F.col("_nt"), "train").otherwise("test")).select(*items.columns, "split")


def cross_split_conflicts(splits: DataFrame, hashes=("file_hash", "phash"), key: str = "label") -> DataFrame:
    """``key, hash_name, conflicts``: test rows whose hash a train row of the label has too; a null label is a label."""
    out = None
    for h in hashes:
        rows = splits.where(F.nullif(F.col(h), F.lit("")).isNotNull())
        in_train = rows.where("split = 'train'").select(key, h).distinct()
        hit = same_join(rows.where("split = 'test'"), in_train, [key, h], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("conflicts")).select(key, F.lit(h).alias("hash_name"), "conflicts")
        out = hit if out is None else out.union(hit)
    return out
