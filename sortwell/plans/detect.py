"""The run over labelled items: detect, keep the best, split, verify, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwell.operators.dedup import key_groups, remapped_groups, unique_items
from sortwell.operators.edges import cosine_edges, hamming_edges
from sortwell.operators.grouping import leader_groups, merge_components, merge_single_pass, numbered_groups, vector_leaders
from sortwell.operators.index import with_position
from sortwell.operators.match import same_join
from sortwell.operators.split import smart_split
from sortwell.session import settle
from sortwell.sources.files import Settings


def led(groups: DataFrame, level: str) -> DataFrame:
    """``label, level, lead, idx`` of leader groups."""
    return groups.select("label", F.lit(level).alias("level"), F.col("leader").alias("lead"), "idx")


def keyed(groups: DataFrame, level: str) -> DataFrame:
    """``label, level, lead, idx`` of numbered groups."""
    return groups.select("label", F.lit(level).alias("level"), F.col("group_no").alias("lead"), "idx")


def in_turn(*parts: DataFrame) -> DataFrame:
    """Numbered groups of several results as one, those of the first before those of the second."""
    out = None
    for n, part in enumerate(parts):
        one = keyed(part, str(n))
        out = one if out is None else out.union(one)
    return numbered_groups(out, [str(n) for n in range(len(parts))])


def vector_edges(features: DataFrame, threshold: float) -> DataFrame:
    """``cosine_edges``, and where vectors come from several methods (``embedding_method``) only those of one method are compared."""
    if "embedding_method" not in features.columns:
        return cosine_edges(features, threshold)
    within = features.withColumn("at", F.struct("label", "embedding_method"))
    return cosine_edges(within, threshold, key="at").select("at.label", "i", "j", "sim", "copy")


def led_by_vectors(features: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``label, level, lead, idx`` of leader groups at several thresholds; where vectors come from several methods (``embedding_method``) only those of one method are compared."""
    if "embedding_method" not in features.columns:
        return vector_leaders(features, limits).withColumnRenamed("leader", "lead")
    within = features.withColumn("at", F.struct("label", "embedding_method"))
    return vector_leaders(within, limits, key="at").select("at.label", "level", F.col("leader").alias("lead"), "idx")


def detect_groups(features: DataFrame, settings: Settings, merge: str = "single_pass", backend: str = "vectors", levels: str = "compat") -> DataFrame:
    """``label, group_no, idx, kind`` over all four levels: exact, near, variation, semantic.

    ``features`` has label, idx, file_hash, phash and v. The leaders of the
    levels of vectors are found in the same rounds. ``merge`` is the
    original's single pass, or ``components``. With ``backend="none"`` only hashes count.

    ``kind`` is ``exact`` for all groups with ``levels="compat"``, as the original has
    it; with ``"intended"`` groups of equal hashes are ``exact`` and the others, merged
    by themselves, are ``near``.
    """
    merged = merge_single_pass if merge == "single_pass" else merge_components
    exact = settle(merged(numbered_groups(keyed(key_groups(features, "file_hash"), "file").union(keyed(key_groups(features, "phash"), "phash")), ["file", "phash"])), "exact")
    if backend == "none":
        parts = [merged(numbered_groups(led(leader_groups(hamming_edges(features)), "perceptual"), ["perceptual"]))]
    else:
        limits = {"near": settings.near_duplicate_threshold, "variation": settings.variation_threshold, "semantic": settings.semantic_threshold}
        found = settle(led_by_vectors(features, limits).union(led(leader_groups(hamming_edges(features)), "perceptual")), "leaders")
        of = lambda *names: numbered_groups(found.where(F.col("level").isin(*names)), list(names))
        parts = [merged(of("near", "perceptual")), of("variation"), of("semantic")]
    if levels == "compat":
        return merged(in_turn(exact, *parts)).withColumn("kind", F.lit("exact"))
    near = merged(in_turn(*parts))
    both = keyed(exact, "exact").union(keyed(near, "near"))
    numbered = numbered_groups(both, ["exact", "near"])
    last = exact.groupBy("label").agg(F.countDistinct("group_no").alias("n_exact"))
    kind = F.when(F.col("group_no") <= F.coalesce("n_exact", F.lit(0)), "exact").otherwise("near")
    return same_join(numbered, last, ["label"], "left").select("label", "group_no", "idx", kind.alias("kind"))


def kept_items(features: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """``features`` without the losers of the groups that the settings remove, with their new positions ``uidx``."""
    away = groups
    if not settings.remove_exact_duplicates:
        away = away.where("kind != 'exact'")
    if settings.keep_near_duplicates:
        away = away.where("kind != 'near'")
    return with_position(unique_items(features, away), "label", [F.col("idx")], "uidx")


def run(features: DataFrame, settings: Settings, merge: str = "single_pass", content: str | None = None, levels: str = "compat", backend: str = "vectors") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, unique items with ``uidx``, their splits). Groups of which two rows are left stay on one side."""
    features = settle(features, "features")
    groups = settle(detect_groups(features, settings, merge, backend, levels), "groups")
    unique = settle(kept_items(features, groups, settings), "unique")
    alive = remapped_groups(groups, unique)
    if content is None and settings.enable_content_filtering:
        content = "compat"
    splits = smart_split(unique.drop("idx").withColumnRenamed("uidx", "idx"), alive, settings.train_ratio, content=content, simple_to_test=settings.simple_to_test_ratio, detailed_to_train=settings.detailed_to_train_ratio)
    return groups, unique, settle(splits, "splits")
