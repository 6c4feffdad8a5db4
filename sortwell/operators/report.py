"""Inventories, counters, reports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortwell.functions.paths import label_text, moved_text, numbered, percent_text, result_text
from sortwell.operators.index import with_position
from sortwell.operators.match import same_join


def label_inventory(files: DataFrame, key: str = "label", side: str = "split") -> DataFrame:
    """``key, train, test, text``: labels of either side with their counts, zero where a side lacks one."""
    counts = files.groupBy(key).agg(*[F.count(F.when(F.col(side) == s, 1)).alias(s) for s in ("train", "test")])
    return counts.withColumn("text", label_text(F.col(key), F.col("train"), F.col("test"))).orderBy(key)


def counters(files: DataFrame, side: str = "split") -> DataFrame:
    """One row: counts of both sides and their shares as text."""
    c = files.agg(*[F.count(F.when(F.col(side) == s, 1)).alias(s) for s in ("train", "test")])
    total = F.col("train") + F.col("test")
    return c.select("train", "test", total.alias("total"), percent_text(F.col("train"), total).alias("train_pct"), percent_text(F.col("test"), total).alias("test_pct"))


def split_report(splits: DataFrame, key: str = "label", measures=("quality", "sharpness", "resolution")) -> DataFrame:
    """``key, split, count, avg_*``: both sides of every label, zeros for an empty one."""
    sides = splits.select(key).distinct().withColumn("split", F.explode(F.array(F.lit("train"), F.lit("test"))))
    got = splits.groupBy(key, "split").agg(F.count(F.lit(1)).alias("count"), *[F.avg(m).alias(f"avg_{m}") for m in measures])
    return same_join(sides, got, [key, "split"], "left").select(key, "split", F.coalesce("count", F.lit(0)).alias("count"), *[F.coalesce(f"avg_{m}", F.lit(0.0)).alias(f"avg_{m}") for m in measures])


def ratio_report(splits: DataFrame, ratio: float, key: str = "label") -> DataFrame:
    """``key, train, test, train_ratio, deviation``."""
    c = splits.groupBy(key).agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "test")])
    share = F.col("train") / (F.col("train") + F.col("test"))
    return c.withColumn("train_ratio", share).withColumn("deviation", F.abs(share - F.lit(float(ratio))))


def group_report(groups: DataFrame, items: DataFrame, path: str = "path", key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, group_id, size, idx, path``: groups numbered from 0 in their order, one row per member."""
    flat = groups.select(key, "group_no", idx)
    heads = with_position(flat.groupBy(key, "group_no").agg(F.count(F.lit(1)).alias("size")), key, [F.col("group_no")], "group_id")
    return same_join(same_join(flat, heads, [key, "group_no"]), items.select(key, idx, path), [key, idx]).select(key, "group_id", "size", idx, path)


def groups_per_side(groups: DataFrame, splits: DataFrame, key: str = "label", idx: str = "idx") -> DataFrame:
    """``key, groups_train, groups_test``, a group counting where its first member is."""
    first = same_join(groups.groupBy(key, "group_no").agg(F.min(idx).alias(idx)), splits.select(key, idx, "split"), [key, idx])
    in_train = F.col("split") == "train"
    return first.groupBy(key).agg(F.count(F.when(in_train, 1)).alias("groups_train"), F.count(F.when(~in_train, 1)).alias("groups_test"))


def copy_manifest(splits: DataFrame, side: str = "split", name: str = "file_name", content: str = "file_hash", order: str = "idx") -> DataFrame:
    """``splits`` without files that a folder has already under their name, plus ``target_name``.

    Of rows with one side, name and content the first is copied. Different files of a
    name get ``_1``, ``_2`` and so on before the suffix, in order. Where such a name is
    another file's own, counting goes on from the highest number that own names in the
    folder carry for the same stem, so targets are unique. Names are numbered by ranges, so
    one that a large part of the files share is many tasks' work.
    """
    once = splits.groupBy(F.col(side).alias("_side"), F.col(name).alias("_name"), F.col(content).alias("_content")).agg(F.min_by(F.struct(*splits.columns), order).alias("_row")).select("_row.*")
    placed = with_position(once.withColumn("_at", F.struct(F.col(side).alias("s"), F.col(name).alias("n"))), "_at", [F.col(order)], "_nth").drop("_at")
    own = placed.select(F.col(side).alias("_side"), F.col(name).alias("_own")).distinct()
    base = F.regexp_replace("_own", r"_(\d{1,9})(?=(\.[^./]*)?$)", "")
    number = F.regexp_extract("_own", r"_(\d{1,9})(?:\.[^./]*)?$", 1)
    used = own.where(number != "").groupBy(F.col("_side"), base.alias("_base")).agg(F.max(number.cast("long")).alias("_used"))
    joined = placed.join(used, (F.col(side) == F.col("_side")) & (F.col(name) == F.col("_base")), "left")
    n = F.when(F.col("_nth") > 0, F.col("_nth") + F.coalesce("_used", F.lit(0))).otherwise(0)
    return joined.withColumn("target_name", numbered(F.col(name), n)).drop("_nth", "_side", "_base", "_used")


def lookup_names(names: DataFrame, files: DataFrame, name: str = "file_name", key: str = "label", side: str = "split") -> DataFrame:
    """``names`` (key, name) with ``split, path`` of the file so called: of the train side if it has one, else of test; null where neither has."""
    order = F.struct((F.col(side) != "train").alias("later"), F.col("path").alias("p"))
    found = files.groupBy(key, name).agg(F.min_by(F.struct(F.col(side).alias("split"), "path"), order).alias("_at"))
    return same_join(names, found, [key, name], "left").select(*names.columns, F.col("_at.split").alias("split"), F.col("_at.path").alias("path"))


def moved(manifest: DataFrame, path: str, side: str = "split") -> DataFrame:
    """``manifest`` with one path sent to the other side. Moving it again undoes the move."""
    other = F.when(F.col(side) == "train", "test").otherwise("train")
    return manifest.withColumn(side, F.when(F.col("path") == path, other).otherwise(F.col(side)))


def move_lines(before: DataFrame, after: DataFrame, key: str = "label", side: str = "split", name: str = "file_name") -> DataFrame:
    """``key, path, line`` of the files whose side differs between two manifests."""
    there = after.select(key, "path", F.col(side).alias("_to"))
    return same_join(before, there, [key, "path"]).where(F.col(side) != F.col("_to")).select(key, "path", moved_text(F.col(name), F.col(side), F.col("_to")).alias("line"))


def run_totals(results: DataFrame) -> DataFrame:
    """One row over per-label results (total_images, duplicates_removed, train_images, test_images); null totals are failed labels and skipped."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return results.where("total_images IS NOT NULL").agg(
        F.count(F.lit(1)).alias("labels_processed"), total("total_images").alias("total_images"), total("duplicates_removed").alias("duplicates_found"),
        total("test_images").alias("moved_to_test"), total("train_images").alias("train_images"), total("test_images").alias("test_images"),
    )


def run_lines(results: DataFrame, key: str = "label") -> DataFrame:
    """``key, line``: the summary's line of each label that was processed."""
    return results.where("total_images IS NOT NULL").select(key, result_text(F.col(key), F.col("total_images"), F.col("duplicates_removed")).alias("line"))


def run_report(found: DataFrame, unique: DataFrame, exact: DataFrame, near: DataFrame, splits: DataFrame, written: DataFrame, settings: dict, key: str = "label") -> DataFrame:
    """One row per label of ``found``: ``key, processing_summary, split_results, verification, settings``.

    ``exact`` and ``near`` are groups (key, group_no, idx), ``splits`` the dealt rows
    and ``written`` one row (key, split) per file that the output holds; what it counts
    is the output, not the plan. ``settings`` gives the flags and values that the run
    had. Members of groups are rows of ``group_report``. A null label is a label.
    """
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    groups = lambda df, name: count(df.select(key, "group_no").distinct(), name)
    files = written.groupBy(key).agg(*[F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_files") for s in ("train", "test")])
    sides = split_report(splits, key)
    results = sides.groupBy(key).agg(*[F.max(F.when(F.col("split") == s, F.struct("count", "avg_quality", "avg_sharpness", "avg_resolution"))).alias(f"{s}_split") for s in ("train", "test")])
    rows = count(found, "n_found")
    for part in (count(unique, "n_unique"), groups(exact, "n_exact"), groups(near, "n_near"), files, results):
        rows = same_join(rows, part, [key], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    copied = n("train_files") + n("test_files")
    flags = ("remove_exact_duplicates", "keep_near_duplicates")
    side = lambda s: F.struct(n(f"{s}_split.count").alias("count"), *[F.coalesce(f"{s}_split.{m}", F.lit(0.0)).alias(m) for m in ("avg_quality", "avg_sharpness", "avg_resolution")], n(f"{s}_files").alias("files_copied")).alias(s)
    return rows.select(
        key,
        F.struct(
            n("n_found").alias("original_images_found"), n("n_unique").alias("unique_images_processed"), copied.alias("images_copied"), n("n_exact").alias("exact_duplicate_groups"), n("n_near").alias("near_duplicate_groups"),
            *[F.lit(settings[f]).alias(f) for f in flags],
        ).alias("processing_summary"),
        F.struct(side("train"), side("test")).alias("split_results"),
        F.struct(n("train_files").alias("train_folder_count"), n("test_files").alias("test_folder_count"), copied.alias("total_output_count"), n("n_unique").alias("expected_unique_count")).alias("verification"),
        F.struct(*[F.lit(v).alias(k) for k, v in settings.items() if k not in flags]).alias("settings"),
    )


def recount(written: DataFrame, expected: DataFrame) -> DataFrame:
    """``split, written, expected, matches`` of files that were written and should be."""
    a = written.groupBy("split").agg(F.count(F.lit(1)).alias("written"))
    b = expected.groupBy("split").agg(F.count(F.lit(1)).alias("expected"))
    return a.join(b, "split", "full_outer").na.fill(0).withColumn("matches", F.col("written") == F.col("expected"))
