"""Reading labelled image folders, images and settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.functions.paths import INVENTORY_SUFFIXES, base_name, has_suffix, parent_name


def has_files(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def scan_folders(spark: SparkSession, roots: dict[str, str], suffixes=INVENTORY_SUFFIXES, label: str | None = None, content: bool = False) -> DataFrame:
    """``split, label, path, file_name, length, modified`` (and ``content``) of ``{split: root}``.

    Files are those directly in a root's label folders, each once, by suffix in any
    case. Unless asked for, content is not read: the reader prunes it. One label
    reads that folder only. A side without the label, or without any, gives no rows.
    """
    none = "split string, label string, path string, file_name string, length long, modified timestamp" + (", content binary" if content else "")
    out = spark.createDataFrame([], none)
    for side, root in roots.items():
        if not has_files(spark, f"{root}/{label or '*'}/*"):
            continue
        read = spark.read.format("binaryFile").load(f"{root}/{label or '*'}/*")
        name, folder = base_name(F.col("path")), parent_name(F.col("path"))
        one = read.select(F.lit(side).alias("split"), folder.alias("label"), "path", name.alias("file_name"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
        one = one.where(has_suffix(F.col("file_name"), suffixes))
        out = out.unionByName(one)
    return out


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, height, width, channels, data`` (rows of BGR or gray bytes); files that can't be decoded are null images."""
    image = spark.read.format("image").option("dropInvalid", False).load(path)
    ok = F.col("image.height") > 0
    return image.select(F.col("image.origin").alias("path"), *[F.when(ok, F.col(f"image.{a}")).alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def valid_images(images: DataFrame) -> DataFrame:
    return images.select("path", F.col("data").isNotNull().alias("valid"))


@dataclass
class Settings:
    """Parameters of a run, with the splitter's defaults; the test share is what train leaves."""

    train_ratio: float = 0.8
    remove_exact_duplicates: bool = True
    keep_near_duplicates: bool = True
    near_duplicate_threshold: float = 0.95
    variation_threshold: float = 0.85
    semantic_threshold: float = 0.80
    hash_threshold: int = 5
    evaluate_models: bool = True
    cross_validation_folds: int = 5
    enable_content_filtering: bool = False
    detailed_to_train_ratio: float = 0.7
    simple_to_test_ratio: float = 0.6
    complexity_threshold: float = 0.6

    def __post_init__(self) -> None:
        if not 0 < self.train_ratio < 1:
            raise ValueError("train_ratio has to lie between 0 and 1")

    @property
    def test_ratio(self) -> float:
        return 1 - self.train_ratio


#: What the settings form starts with, by its own names.
FORM_DEFAULTS = {
    "train_ratio": 0.75, "similarity_threshold": 0.92, "hash_threshold": 8, "remove_exact_duplicates": True, "keep_near_duplicates": False, "rotation_similarity_threshold": 0.88,
    "foreground_similarity_threshold": 0.90, "cross_validation_folds": 5, "evaluate_models": True, "test_mode": False, "test_label": "", "enable_content_filtering": False,
    "complexity_threshold": 0.6, "content_balance_ratio": 0.7, "prefer_complex_in_train": True, "prefer_simple_in_test": True,
}
#: Which of the form's names feed which parameter.
FORM_NAMES = {"similarity_threshold": "near_duplicate_threshold", "rotation_similarity_threshold": "variation_threshold", "foreground_similarity_threshold": "semantic_threshold", "content_balance_ratio": "detailed_to_train_ratio"}


def load_json(path: str) -> dict:
    """The object in a JSON file; empty where the file is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def save_json(path: str, values: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2)


def settings_from(config: dict) -> Settings:
    """Settings from a nested or flat JSON object; what it lacks keeps its default."""
    flat = {k: v for k, v in config.items() if not isinstance(v, dict)}
    for part in config.values():
        if isinstance(part, dict):
            flat |= part
    flat = {FORM_NAMES.get(k, k): v for k, v in flat.items()}
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in flat.items() if k in known})
