"""Label folders as a data source: ``spark.read.format("label_folders").option("train", ROOT).option("test", ROOT)``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sortwell.functions.paths import INVENTORY_SUFFIXES
from sortwell.operators.report import label_inventory
from sortwell.session import ship

_SCHEMA = "split string, label string, path string, file_name string, suffix string, length long, modified timestamp"
#: Files in a batch.
ROWS = 10_000


@dataclass
class LabelFolder(InputPartition):
    """One label's folder on one side."""

    split: str
    label: str
    path: str

    def __init__(self, split: str, label: str, path: str) -> None:
        super().__init__(None)
        self.split, self.label, self.path = split, label, path


class FolderReader(DataSourceReader):
    """A partition is a label's folder. Filters on split and label leave folders unlisted, those on suffix are applied as files are listed."""

    def __init__(self, roots: dict[str, str], suffixes: set[str], empty: bool) -> None:
        self.roots, self.suffixes, self.empty = roots, suffixes, empty
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("split",), ("label",), ("suffix",)):
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = self.wanted.get(name, values) & values

    def _wants(self, name: str, value: str) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def partitions(self) -> list[LabelFolder]:
        found = []
        for split, root in self.roots.items():
            if not self._wants("split", split):
                continue
            files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
            one = self.wanted.get("label")
            if one is not None:  # these folders only; the root isn't listed
                there = [x for x in files.get_file_info([f"{base}/{label}" for label in sorted(one) if label]) if x.type == fs.FileType.Directory]
            else:
                there = [x for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory]
            prefix = root.split("://", 1)[0] + "://" if "://" in root else ""
            found += [LabelFolder(split, x.base_name, prefix + x.path) for x in there]
        return found

    def read(self, partition: LabelFolder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no folder at all
            return
        files, base = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        rows, any_ = [], False
        for x in files.get_file_info(fs.FileSelector(base)):
            suffix = x.extension.lower()
            if x.type != fs.FileType.File or suffix not in self.suffixes:
                continue
            any_ = True
            if self._wants("suffix", suffix):
                rows.append((partition.split, partition.label, partition.path + "/" + x.base_name, x.base_name, suffix, x.size, x.mtime))
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if not any_ and self.empty and "suffix" not in self.wanted:
            rows.append((partition.split, partition.label, None, None, None, None, None))
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.timestamp("us", "UTC")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["split", "label", "path", "file_name", "suffix", "length", "modified"])


class LabelFolders(DataSource):
    """Files directly in the label folders of ``train`` and ``test``, by suffix in any case.

    Options: ``train``, ``test`` (folders, or addresses that pyarrow can list), ``suffixes``
    (separated by commas), and ``empty``: whether a label folder without such files
    gives a row with a null path, so that inventories know it.
    """

    @classmethod
    def name(cls) -> str:
        return "label_folders"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FolderReader:
        roots = {s: self.options[s].rstrip("/") for s in ("train", "test") if self.options.get(s)}
        suffixes = {x.strip().lower().lstrip(".") for x in self.options.get("suffixes", ",".join(INVENTORY_SUFFIXES)).split(",")}
        return FolderReader(roots, suffixes, str(self.options.get("empty", "false")).lower() == "true")


def label_folders(spark: SparkSession, roots: dict[str, str], empty: bool = False, **options: str) -> DataFrame:
    """``{split: root}`` as ``split, label, path, file_name, suffix, length, modified``; registers the source, with filters pushed into it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LabelFolders)
    return spark.read.format("label_folders").options(**roots, empty=str(empty).lower(), **options).load()


def folder_inventory(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """``label_inventory`` of the folders, with a line for labels without files too."""
    files = label_folders(spark, roots, empty=True)
    return label_inventory(files.withColumn("split", F.when(F.col("path").isNotNull(), F.col("split"))))
