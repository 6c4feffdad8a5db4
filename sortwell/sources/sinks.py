"""Writing manifests, copies and reports."""

from __future__ import annotations

import hashlib
import os
import shutil
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sortwell.functions.paths import base_name, parent_name
from sortwell.sources.files import has_files


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("errorifexists").partitionBy("split").parquet(path)


def copy_files(manifest: DataFrame, out: str, by_label: bool = False) -> DataFrame:
    """Copy the manifest's files to ``out/split/target_name`` and return ``split, copied``.

    ``out`` has to be a folder that all executors mount. A file that stands there
    already with the same content is left, so a task that runs again does no harm.
    """
    cols = ["split", "path", "target_name"] + (["label"] if by_label else [])

    def run(rows: list[Row] | object):
        done: dict[str, int] = {}
        for r in rows:
            source = unquote(urlparse(r.path).path) if ":" in r.path else r.path
            folder = os.path.join(out, r.split, *([r.label] if by_label else []))
            os.makedirs(folder, exist_ok=True)
            target = os.path.join(folder, r.target_name)
            if not (os.path.exists(target) and _md5(target) == _md5(source)):
                part = f"{target}.{os.getpid()}.part"
                shutil.copy2(source, part)
                os.replace(part, target)
            done[r.split] = done.get(r.split, 0) + 1
        return list(done.items())

    # a physical copy is per-file work with a side effect, for which there is no relational operator
    counted = manifest.select(*cols).rdd.mapPartitions(run)
    return manifest.sparkSession.createDataFrame(counted, "split string, copied long").groupBy("split").agg(F.sum("copied").alias("copied"))


def _md5(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def written_files(spark: SparkSession, out: str, labels: bool = True) -> DataFrame:
    """``split, label, file_name`` of the files that stand in ``out/split/label`` (``out/split`` without labels)."""
    found = None
    for side in ("train", "test"):
        pattern = f"{out}/{side}/*/*" if labels else f"{out}/{side}/*"
        if has_files(spark, pattern):
            names = spark.read.format("binaryFile").load(pattern).select("path")
            label = parent_name(F.col("path")) if labels else F.lit(None).cast("string")
            one = names.select(F.lit(side).alias("split"), label.alias("label"), base_name(F.col("path")).alias("file_name"))
            found = one if found is None else found.union(one)
    return found if found is not None else spark.createDataFrame([], "split string, label string, file_name string")


def write_report(report: DataFrame, groups: DataFrame, out: str) -> None:
    """The run's report as JSON lines: ``summary``, a line per label, and ``groups``, a line per member of a group.

    A group is not gathered into a line, since copies of one image may be a large part of all.
    """
    report.write.mode("errorifexists").json(f"{out}/summary")
    groups.write.mode("errorifexists").json(f"{out}/groups")
