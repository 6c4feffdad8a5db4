"""Command line: scan folders, measure, evaluate, deduplicate, split, and write the manifest and report."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.functions.embedding import embed_chain
from sortwell.functions.measures import composite_score, content_type, exposure, mean, spread
from sortwell.functions.paths import SORTER_SUFFIXES, base_name
from sortwell.functions.rasters import image_measures
from sortwell.functions.vectors import average_hash
from sortwell.operators.evaluate import evaluate_configs
from sortwell.operators.index import with_position
from sortwell.operators.report import copy_manifest, group_report, recount, run_lines, run_report, run_totals
from sortwell.plans.detect import run
from sortwell.session import settle
from sortwell.sources.files import Settings, has_files, load_json, read_images, scan_folders, settings_from
from sortwell.sources.sinks import copy_files, write_manifest, write_report, written_files
from sortwell.sources.versions import replace_labels


def folder_features(spark: SparkSession, roots: dict[str, str], settings: Settings, label: str | None = None, models: list[str] | None = None) -> DataFrame:
    """Features of every image of the labels (or one label) in ``{split: root}``, with positions by path.

    Images that can't be decoded are left out. Vectors come from ``models``, names
    ``module:function`` of functions that load one, tried in order, else they are color histograms.
    Hashes and quality are column expressions over the gray levels of a thumbnail.
    """
    files = scan_folders(spark, roots, SORTER_SUFFIXES, label, content=True).select("label", "path", F.md5("content").alias("file_hash"))
    images = read_images(spark, [f"{root}/{label or '*'}" for root in roots.values() if has_files(spark, f"{root}/{label or '*'}/*")])
    joined = files.join(images, F.regexp_replace(files["path"], "^file:/+", "/") == F.regexp_replace(images["path"], "^file:/+", "/")).drop(images["path"])
    method = F.lit("histogram").alias("embedding_method")
    if models:
        named = [m.split(":") for m in models]
        vectors = embed_chain(joined, {name: getattr(importlib.import_module(module), name) for module, name in named}).select("path", "embedding", "embedding_method")
        rows = image_measures(joined).join(vectors, "path")
        method = F.col("embedding_method")
    else:
        rows = image_measures(joined).withColumn("embedding", F.col("histogram"))
    thumb = F.col("thumb")
    quality = composite_score(F.col("sharpness"), mean(thumb), spread(thumb), F.lit(0.0), F.col("resolution"), F.least(F.lit(1.0), F.col("sharpness") / 255.0), F.lit(0.0), exposure(thumb))
    # types are measured only where they decide anything
    complexity, kind = F.lit(None).cast("double"), F.lit("unknown")
    if settings.enable_content_filtering:
        complexity = F.least(F.lit(1.0), spread(thumb) / 80.0)
        kind = content_type(complexity, F.lit(None).cast("double"), F.lit(None).cast("int"), settings.complexity_threshold)
    flat = rows.where("thumb IS NOT NULL").select(
        "label", "path", base_name(F.col("path")).alias("file_name"), "file_hash", average_hash(thumb).alias("phash"), F.col("embedding").cast("array<double>").alias("v"), method, quality.alias("quality"), "sharpness", "resolution",
        complexity.alias("complexity_score"), F.lit(None).cast("double").alias("completeness_score"), kind.alias("content_type"),
    )
    return settle(with_position(flat, "label", [F.col("path")]), "features")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--train", required=True)
    p.add_argument("--test", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--label")
    p.add_argument("--config", default="")
    p.add_argument("--model", action="append", help="module:function that loads an embedding model; more of them are fallbacks in order")
    p.add_argument("--train-ratio", type=float)
    p.add_argument("--folds", type=int, help="folds by which configurations are compared")
    p.add_argument("--no-evaluation", action="store_true")
    p.add_argument("--keep-all", action="store_true", help="keep duplicates, together on one side")
    p.add_argument("--intended", action="store_true", help="tell near duplicates from exact ones, and keep or remove them by the settings")
    p.add_argument("--components", action="store_true", help="merge groups as long as any overlap")
    p.add_argument("--copy", action="store_true", help="copy the files too")
    p.add_argument("--store", help="folder of versions; the result becomes the content of its labels in a new one")
    a = p.parse_args(argv)
    settings = settings_from(load_json(a.config) | {k: v for k, v in (("train_ratio", a.train_ratio), ("cross_validation_folds", a.folds)) if v is not None})
    settings.remove_exact_duplicates = settings.remove_exact_duplicates and not a.keep_all
    spark = SparkSession.builder.appName("sortwell").getOrCreate()
    features = folder_features(spark, {"train": a.train, "test": a.test}, settings, a.label, a.model)
    if settings.evaluate_models and not a.no_evaluation:
        evaluate_configs(features, settings.cross_validation_folds, near=settings.near_duplicate_threshold).write.mode("errorifexists").json(f"{a.output}/evaluation")
    groups, unique, splits = run(features, settings, "components" if a.components else "single_pass", levels="intended" if a.intended else "compat")
    manifest = settle(copy_manifest(splits.withColumn("folder", F.concat("split", F.lit("/"), "label")), "folder"), "manifest")
    write_manifest(manifest, f"{a.output}/manifest")
    if a.store:
        version, totals = replace_labels(manifest, a.store)
        print(f"version {version}: {totals}")
    if a.copy:
        copy_files(manifest, a.output, by_label=True).show()
        written = settle(written_files(spark, a.output), "written")
        recount(written, manifest).show()
    else:
        written = manifest.select("label", "split").where("false")
    exact, near = (groups.where(F.col("kind") == kind) for kind in ("exact", "near"))
    values = {
        "remove_exact_duplicates": settings.remove_exact_duplicates, "keep_near_duplicates": settings.keep_near_duplicates, "train_ratio": settings.train_ratio, "test_ratio": settings.test_ratio,
        "similarity_threshold": settings.near_duplicate_threshold, "hash_threshold": settings.hash_threshold, "embedding_method": ",".join(m.split(":")[1] for m in a.model) if a.model else "histogram",
    }
    report = settle(run_report(features, unique, exact, near, splits, written, values), "report")
    write_report(report, group_report(groups, features), f"{a.output}/split_analysis")
    per_label = report.select("label", F.col("processing_summary.original_images_found").alias("total_images"), (F.col("processing_summary.exact_duplicate_groups") + F.col("processing_summary.near_duplicate_groups")).alias("duplicates_removed"), F.col("split_results.train.count").alias("train_images"), F.col("split_results.test.count").alias("test_images"))
    run_totals(per_label).show()
    run_lines(per_label).show(truncate=False)


if __name__ == "__main__":
    main()
