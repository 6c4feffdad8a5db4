"""Versions of the label folders: replacing them by a result, moving files, and going back.

A store is a folder that all executors reach:

``files/version=N/folder=F``  rows of the manifest of one label, written by version N
``labels/version=N``          which version holds the rows of each label in version N
``commits/N``                 an empty file, made last: version N counts once it is there

Readers only follow commits, so a run that is stopped between labels leaves the version
before it as it was. Nothing is overwritten but what an uncommitted run of the same number left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sortwell.operators.match import same_join
from sortwell.operators.report import moved
from sortwell.sources.sinks import copy_files


def _folder() -> Column:
    """Name of a label's folder; a null label and an empty one have folders too."""
    return F.coalesce(F.concat(F.lit("label-"), F.col("label")), F.lit("none"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, in order."""
    at, fs = _fs(spark, f"{root}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []


def _commit(spark: SparkSession, root: str, version: int) -> int:
    at, fs = _fs(spark, f"{root}/commits/{version}")
    fs.create(at, False).close()  # fails where another run has committed the same number
    return version


def _labels(spark: SparkSession, root: str, version: int) -> DataFrame:
    """``folder, held``: the version that holds the rows of each label's folder."""
    return spark.read.schema("folder string, held int").parquet(f"{root}/labels/version={version}")


def replace_labels(manifest: DataFrame, root: str, copy_to: str | None = None) -> tuple[int, dict[str, int]]:
    """Make ``manifest`` (``label, split, path, target_name``, more) the content of its labels; the others stay. The version's number, and totals.

    Each label's rows replace what an unfinished run left (dynamic overwrite by label).
    Totals are observed in the write itself, so nothing is read again for them. With
    ``copy_to`` the files are copied to ``copy_to/N/split/label`` as well, and the version is
    committed only if as many were copied as the manifest has.
    """
    spark = manifest.sparkSession
    last = max(versions(spark, root), default=0)
    n = last + 1
    observed = Observation()
    counted = manifest.withColumns({"folder": _folder(), "version": F.lit(n)}).observe(observed, F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test")])
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "folder").parquet(f"{root}/files")
    totals = dict(observed.get)
    mine = manifest.select(_folder().alias("folder")).distinct().withColumn("held", F.lit(n))
    if last:
        mine = mine.union(same_join(_labels(spark, root, last), mine, ["folder"], "left_anti"))
    mine.write.mode("overwrite").parquet(f"{root}/labels/version={n}")
    if copy_to is not None:
        copied = sum(r.copied for r in copy_files(manifest, f"{copy_to}/{n}", by_label=True).collect())
        if copied != totals["files"]:
            raise RuntimeError(f"{copied} of {totals['files']} files were copied; version {n} is not committed")
    return _commit(spark, root, n), totals


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The manifest of a version, the last one unless named; folders of other versions are pruned by the join with its labels."""
    known = versions(spark, root)
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"version {version} is not committed")
    held = _labels(spark, root, version)
    files = spark.read.option("basePath", f"{root}/files").option("mergeSchema", "true").parquet(f"{root}/files")
    rows = files.join(F.broadcast(held), (files["folder"] == held["folder"]) & (files["version"] == held["held"]))  # a row per label
    return rows.drop(held["folder"], "held", files["folder"], files["version"])


def return_to(spark: SparkSession, root: str, version: int) -> int:
    """A new version that is ``version`` again; no file is written but the list of labels."""
    if version not in versions(spark, root):
        raise ValueError(f"version {version} is not committed")
    n = max(versions(spark, root)) + 1
    _labels(spark, root, version).write.mode("overwrite").parquet(f"{root}/labels/version={n}")
    return _commit(spark, root, n)


def undo(spark: SparkSession, root: str) -> int:
    """A new version that is the one before the last."""
    known = versions(spark, root)
    if len(known) < 2:
        raise ValueError("there is no version to go back to")
    return return_to(spark, root, known[-2])


def move_file(spark: SparkSession, root: str, path: str) -> int:
    """A new version in which one file is on the other side; only its label is written."""
    now = read_version(spark, root)
    label = now.where(F.col("path") == path).select("label").limit(1)
    if label.isEmpty():
        raise ValueError(f"{path} is in no label")
    return replace_labels(moved(same_join(now, label, ["label"], "left_semi"), path), root)[0]


def history(spark: SparkSession, root: str) -> DataFrame:
    """``version, label, held, train, test``: all versions side by side, and which of them wrote the label."""
    out = None
    for v in versions(spark, root):
        one = _labels(spark, root, v).select(F.lit(v).alias("version"), "folder", "held")
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("there is no version")
    files = spark.read.parquet(f"{root}/files")
    counts = files.groupBy(F.col("version").alias("held"), "folder").agg(F.first("label").alias("label"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test")])
    return out.join(counts, ["held", "folder"]).select("version", "label", "held", "train", "test")
