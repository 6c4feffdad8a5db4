"""Keeping the best row of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwell.operators.match import same_join
from sortwell.operators.spread import with_group


def key_groups(items: DataFrame, hash_col: str, key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, hash, n, group_no, idx``: rows of hashes that several rows of a label share, numbered by their first position.

    Empty hashes are missing ones. A hash that a large part of the rows share is spread
    over sub-keys, and its rows stay rows. A null label is a label.
    """
    rows = items.select(key, F.nullif(F.col(hash_col), F.lit("")).alias("hash"), idx).where("hash IS NOT NULL")
    found = with_group(rows, [key, "hash"], {"group_no": F.min(idx)}, idx).where("group_n > 1")
    return found.select(key, "hash", F.col("group_n").alias("n"), "group_no", idx)


def best_of_groups(groups: DataFrame, items: DataFrame, quality: str = "quality", key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, group_no, best``: the group's row of highest quality, ties to the smaller position."""
    rows = same_join(groups.select(key, "group_no", idx), items.select(key, idx, quality), [key, idx])
    return rows.groupBy(key, "group_no").agg(F.max_by(idx, F.struct(F.col(quality), -F.col(idx))).alias("best"))


def losers(groups: DataFrame, items: DataFrame, quality: str = "quality", key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, idx`` of rows that lose in any of their groups."""
    best = best_of_groups(groups, items, quality, key, idx)
    return same_join(groups.select(key, "group_no", idx), best, [key, "group_no"]).where(F.col(idx) != F.col("best")).select(key, idx).distinct()


def unique_items(items: DataFrame, groups: DataFrame, quality: str = "quality", key: str = "label", idx: str = "idx") -> DataFrame:
    """``items`` without the losers of every group."""
    return same_join(items, losers(groups, items, quality, key, idx), [key, idx], "left_anti")


def remapped_groups(groups: DataFrame, unique: DataFrame, key: str = "label", idx: str = "idx", new_idx: str = "uidx") -> DataFrame:
    """``groups`` in the positions of ``unique`` (as ``idx``); groups with fewer than two survivors go."""
    flat = same_join(groups.select(key, "group_no", idx), unique.select(key, idx, new_idx), [key, idx]).select(key, "group_no", F.col(new_idx).alias(idx))
    return with_group(flat, [key, "group_no"], {}, idx).where("group_n > 1").drop("group_n")


def weighted_best(items: DataFrame, key: str = "group") -> DataFrame:
    """``items`` of each group's best row by the weighted score, with ``score`` and ``reasons``.

    Needs quality_score, sharpness, resolution, edge_density, color_richness,
    exposure_quality, brightness, contrast, noise_quality and idx; a null metric counts
    as its neutral value.
    """
    c = lambda name, default: F.coalesce(F.col(name), F.lit(float(default)))
    well_lit = c("brightness", 128).between(100, 155)
    # fixed values: weights, cutoffs and the texts of reasons
    weights = {"sharpness": 0.15, "resolution": 0.15 / 10000.0, "edge_density": 0.1, "color_richness": 0.1, "exposure_quality": 0.1}
    score = F.col("quality_score") * 0.4
    for name, w in weights.items():
        score = score + c(name, 0) * w
    score = score + F.when(well_lit, 0.05).otherwise(0.0) + F.when(c("contrast", 0) > 30, 0.03).otherwise(0.0) - F.when(c("noise_quality", 0.5) < 0.2, 0.1).otherwise(0.0)
    tests = [
        (F.col("quality_score") > 0.7, "high overall quality"),
        (c("sharpness", 0) > 500, "excellent sharpness"),
        (c("resolution", 0) > 5000, "high resolution"),
        (c("edge_density", 0) > 0.15, "rich detail"),
        (c("color_richness", 0) > 0.6, "vibrant colors"),
        (well_lit, "optimal exposure"),
    ]
    found = F.array_compact(F.array(*[F.when(test, text) for test, text in tests]))
    reasons = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("best available quality")))
    best = F.max_by(F.struct("idx", "score", "reasons"), F.struct(F.col("score"), -F.col("idx")))
    return items.withColumn("score", score).withColumn("reasons", reasons).groupBy(key).agg(best.alias("b")).select(key, "b.*").withColumnRenamed("idx", "best")
