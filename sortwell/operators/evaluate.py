"""k-fold metrics over contiguous folds, and the ranking of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortwell.operators.dedup import key_groups
from sortwell.operators.grouping import vector_leaders
from sortwell.operators.match import same_join

#: The configurations that are compared, in their order.
CONFIGS = (
    {"name": "Default"},
    {"name": "Conservative", "similarity_threshold": 0.95, "hash_threshold": 3, "exact_duplicate_threshold": 0.99, "near_duplicate_threshold": 0.98},
    {"name": "Aggressive", "similarity_threshold": 0.75, "hash_threshold": 8, "exact_duplicate_threshold": 0.95, "near_duplicate_threshold": 0.85},
    {"name": "Balanced Split", "train_ratio": 0.7, "similarity_threshold": 0.88, "hash_threshold": 4, "exact_duplicate_threshold": 0.98, "near_duplicate_threshold": 0.92},
    {"name": "Quality Focused", "similarity_threshold": 0.85, "hash_threshold": 6, "exact_duplicate_threshold": 0.97, "near_duplicate_threshold": 0.90, "enable_content_filtering": True, "complexity_threshold": 0.7},
)


def fold_of(idx: Column, n: Column, folds: int) -> Column:
    """Folds of ``n // folds`` consecutive rows; the last one takes the rest (all, if there are fewer rows than folds)."""
    size = F.floor(n / folds)
    return F.when(size == 0, folds - 1).otherwise(F.least(F.floor(idx / F.greatest(size, F.lit(1))), F.lit(folds - 1))).cast("int")

#: What ``kfold_metrics`` measures besides the overall score.
METRICS = ("train_quality_avg", "test_quality_avg", "train_test_quality_diff", "duplicate_detection_rate", "cross_split_duplicates")


def with_folds(items: DataFrame, folds: int, key: str = "label", idx: str = "idx") -> DataFrame:
    n = items.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return items.join(n, F.col(key).eqNullSafe(F.col("_k"))).withColumn("fold", fold_of(F.col(idx), F.col("_n"), folds)).drop("_k", "_n")


def kfold_metrics(items: DataFrame, n_groups: DataFrame, folds: int = 5, key: str = "label", idx: str = "idx", quality: str = "quality", hash_col: str = "file_hash") -> DataFrame:
    """One row per label: the five metrics' means over the folds and the overall score.

    Rows are summed up per fold once, as decimals of nine places, so a sum is the same
    at every partitioning; a fold's train side is the label less the fold. A hash is
    in a fold's both sides if it occurs in the fold and outside of it. A fold without
    rows makes the averages NaN, as a mean of nothing. A null label is a label; a
    quality that is null or not finite counts as 0.
    """
    placed = with_folds(items, folds, key, idx)
    exact = F.coalesce(F.col(quality).try_cast("decimal(18,9)"), F.lit(0).cast("decimal(18,9)"))
    per_fold = placed.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(exact).alias("q"))
    spread = placed.where(F.nullif(F.col(hash_col), F.lit("")).isNotNull()).select(key, hash_col, "fold").distinct()
    in_folds = spread.groupBy(key, hash_col).agg(F.count(F.lit(1)).alias("in_folds")).where("in_folds > 1")
    crossing = same_join(spread, in_folds, [key, hash_col]).groupBy(key, "fold").agg(F.count(F.lit(1)).alias("crossing"))
    whole = per_fold.groupBy(key).agg(F.sum("n").alias("all_n"), F.sum("q").alias("all_q"))
    each = whole.select(key, "all_n", "all_q", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    each = same_join(same_join(each, per_fold, [key, "fold"], "left"), crossing, [key, "fold"], "left").na.fill(0, ["n", "crossing"])
    nan = F.lit(float("nan"))
    test = F.when(F.col("n") > 0, F.col("q").cast("double") / F.col("n")).otherwise(nan)
    rest_n = F.col("all_n") - F.col("n")
    train = F.when(rest_n > 0, (F.col("all_q") - F.coalesce("q", F.lit(0))).cast("double") / rest_n).otherwise(nan)
    means = each.withColumn("te", test).withColumn("tr", train).groupBy(key).agg(
        F.avg("tr").alias("train_quality_avg"), F.avg("te").alias("test_quality_avg"), F.avg(F.abs(F.col("tr") - F.col("te"))).alias("train_test_quality_diff"), F.avg("crossing").alias("cross_split_duplicates"), F.first("all_n").alias("all_n")
    )
    rate = F.coalesce(F.col("n_groups"), F.lit(0)) / F.col("all_n")
    score = (F.col("train_quality_avg") + F.col("test_quality_avg")) / 2 * 0.4 + (1.0 - F.col("train_test_quality_diff")) * 0.3 + rate * 0.2 + (1.0 - F.col("cross_split_duplicates") / 10.0) * 0.1
    return same_join(means, n_groups.select(key, "n_groups"), [key], "left").withColumn("duplicate_detection_rate", rate).withColumn("overall_score", score).drop("all_n", "n_groups")


def rank_configs(scored: DataFrame, key: str = "label") -> DataFrame:
    """``scored`` (key, config_no, overall_score) plus ``place``: falling score, ties and NaN to the earlier configuration."""
    usable = F.when(~F.isnan("overall_score"), F.col("overall_score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(usable.desc_nulls_last(), "config_no")).cast("long"))


def evaluate_configs(features: DataFrame, folds: int = 5, configs=CONFIGS, near: float = 0.95) -> DataFrame:
    """``label, config_no, config, overall_score, place`` and the metrics: configurations by score, each with the groups that its own near threshold finds.

    The metrics are those of ``kfold_metrics``; the rate of detected duplicates counts the
    exact groups and the configuration's near ones.
    The groups of all configurations are found in the same rounds. Scores are rounded to nine places
    before they are ranked.
    """
    limits = [(n, float(c.get("near_duplicate_threshold", near))) for n, c in enumerate(configs)]
    led = vector_leaders(features, {str(n): t for n, t in limits}).select("label", F.col("level").cast("int").alias("config_no"), "leader")
    found = led.distinct().groupBy("label", "config_no").agg(F.count(F.lit(1)).alias("near"))
    exact = key_groups(features, "file_hash").select("label", "group_no").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n_groups"))
    names = F.array(*[F.struct(F.lit(n).alias("config_no"), F.lit(c["name"]).alias("config")) for n, c in enumerate(configs)])
    runs = kfold_metrics(features, exact, folds).select("label", "overall_score", *METRICS, F.inline(names))
    n = features.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = same_join(same_join(runs, found, ["label", "config_no"], "left"), n, ["label"])
    near_rate = F.coalesce("near", F.lit(0)) / F.col("n")
    score = F.round(F.col("overall_score") + near_rate * 0.2, 9)
    return rank_configs(rows.withColumns({"overall_score": score, "duplicate_detection_rate": F.col("duplicate_detection_rate") + near_rate}).select("label", "config_no", "config", "overall_score", *METRICS))
