"""Versions of the label folders, and the folders as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from sortwell.operators.report import run_totals
from sortwell.sources import folders, versions
from sortwell.sources.folders import FolderReader
from pyspark.sql.datasource import EqualTo, GreaterThan, In


def manifest(spark, rows):
    return spark.createDataFrame(rows, "label string, split string, path string, target_name string")


ROWS = [("a", "train", "/a/1.jpg", "1.jpg"), ("a", "test", "/a/2.jpg", "2.jpg"), ("b c", "train", "/b/1.jpg", "1.jpg"), ("007", "train", "/7/x.jpg", "x.jpg"), (None, "test", "/n/1.jpg", "1.jpg"), ("", "train", "/e/1.jpg", "1.jpg")]


def state(spark, root, version=None):
    return sorted(((r.label, r.split, r.path, r.target_name) for r in versions.read_version(spark, root, version).collect()), key=repr)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    n, totals = versions.replace_labels(manifest(spark, ROWS), root)
    assert (n, totals) == (1, {"files": 6, "train": 4, "test": 2})
    assert state(spark, root) == sorted(ROWS, key=repr)
    new = [("a", "test", "/a/1.jpg", "1.jpg")]
    assert versions.replace_labels(manifest(spark, new), root)[0] == 2
    rest = [r for r in ROWS if r[0] != "a"]
    assert state(spark, root) == sorted(rest + new, key=repr) and state(spark, root, 1) == sorted(ROWS, key=repr)
    assert versions.undo(spark, root) == 3 and state(spark, root) == sorted(ROWS, key=repr)
    assert versions.move_file(spark, root, "/n/1.jpg") == 4
    assert [r for r in state(spark, root) if r[0] is None] == [(None, "train", "/n/1.jpg", "1.jpg")] and len(state(spark, root)) == 6
    got = {(r.version, r.label): (r.held, r.train, r.test) for r in versions.history(spark, root).collect()}
    assert got[1, "a"] == (1, 1, 1) and got[2, "a"] == (2, 0, 1) and got[3, "a"] == (1, 1, 1) and got[4, None] == (4, 1, 0) and got[4, "007"] == (1, 1, 0)
    with pytest.raises(ValueError):
        versions.return_to(spark, root, 9)


def test_a_run_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    versions.replace_labels(manifest(spark, ROWS), root)

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_commit", stop)
    with pytest.raises(KeyboardInterrupt):
        versions.replace_labels(manifest(spark, [("a", "test", "/a/9.jpg", "9.jpg"), ("b c", "test", "/b/9.jpg", "9.jpg")]), root)
    monkeypatch.undo()
    assert state(spark, root) == sorted(ROWS, key=repr)
    # the next run takes the same number; what the stopped one wrote for other labels counts for nothing
    assert versions.replace_labels(manifest(spark, [("a", "train", "/a/3.jpg", "3.jpg")]), root)[0] == 2
    assert state(spark, root) == sorted([r for r in ROWS if r[0] != "a"] + [("a", "train", "/a/3.jpg", "3.jpg")], key=repr)


def test_files_are_copied_before_a_version_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("1.jpg", "2.jpg"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    rows = [("a", "train", str(tmp_path / "in/1.jpg"), "1.jpg"), ("a", "test", str(tmp_path / "in/2.jpg"), "x.jpg")]
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    assert versions.replace_labels(manifest(spark, rows), root, out)[0] == 1
    assert (tmp_path / "out/1/train/a/1.jpg").read_bytes() == b"1.jpg" and (tmp_path / "out/1/test/a/x.jpg").read_bytes() == b"2.jpg"
    with pytest.raises(Exception, match="missing.jpg"):
        versions.replace_labels(manifest(spark, [("a", "train", str(tmp_path / "in/missing.jpg"), "m.jpg")]), root, out)
    assert versions.versions(spark, root) == [1]


def test_totals_come_with_the_write(spark, tmp_path):
    """As many as a second pass finds, without its job."""
    df = manifest(spark, ROWS)
    per_label = df.groupBy("label").agg(F.count(F.lit(1)).alias("total_images"), F.lit(0).alias("duplicates_removed"), F.count_if(F.col("split") == "train").alias("train_images"), F.count_if(F.col("split") == "test").alias("test_images"))
    want = run_totals(per_label).first()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("totals", "totals")
    try:
        _, totals = versions.replace_labels(df, str(tmp_path / "store"))
        jobs = len(tracker.getJobIdsForGroup("totals"))
        run_totals(per_label).collect()
        more = len(tracker.getJobIdsForGroup("totals")) - jobs
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert totals == {"files": want.total_images, "train": want.train_images, "test": want.test_images} and more >= 1


@pytest.fixture
def roots(tmp_path):
    for name in ("train/leaf/a.jpg", "train/leaf/b.PNG", "train/leaf/notes.txt", "train/leaf/deep/c.jpg", "test/leaf/d.jpg", "test/root/e.tiff", "train/loose.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    (tmp_path / "train/bare").mkdir()
    return {"train": str(tmp_path / "train"), "test": str(tmp_path / "test")}


def test_label_folders(spark, roots):
    df = folders.label_folders(spark, roots)
    assert sorted((r.split, r.label, r.file_name, r.suffix, r.length) for r in df.collect()) == [("test", "leaf", "d.jpg", "jpg", 3), ("test", "root", "e.tiff", "tiff", 3), ("train", "leaf", "a.jpg", "jpg", 3), ("train", "leaf", "b.PNG", "png", 3)]
    assert sorted(r.file_name for r in df.where("label = 'leaf' AND suffix IN ('jpg', 'gif') AND length > 1").collect()) == ["a.jpg", "d.jpg"]
    assert df.where("split = 'train'").rdd.getNumPartitions() == 2 and df.where("label = 'leaf'").rdd.getNumPartitions() == 2
    assert df.where("label = 'leaf' AND split = 'test'").rdd.getNumPartitions() == 1
    assert [(r.label, r.train, r.test) for r in folders.folder_inventory(spark, roots).collect()] == [("bare", 0, 0), ("leaf", 2, 1), ("root", 0, 1)]
    assert folders.label_folders(spark, {"train": roots["train"] + "/none"}).count() == 0


def test_filters_leave_folders_unlisted(roots, monkeypatch):
    reader = FolderReader(roots, {"jpg"}, False)
    left = list(reader.pushFilters([EqualTo(("label",), "leaf"), In(("suffix",), ["jpg", "png"]), EqualTo(("suffix",), "jpg"), GreaterThan(("length",), 1), EqualTo(("split",), "train")]))
    assert left == [GreaterThan(("length",), 1)] and reader.wanted == {"label": {"leaf"}, "suffix": {"jpg"}, "split": {"train"}}
    os.chmod(roots["train"], 0o311)  # the root can't be listed
    try:
        assert [(p.split, p.label) for p in reader.partitions()] == [("train", "leaf")]
    finally:
        os.chmod(roots["train"], 0o755)
    assert FolderReader(roots, {"jpg"}, False).partitions()[0].label
