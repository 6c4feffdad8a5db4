"""Images from PNG files that are made here, through Spark's image source."""

import json
import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from sortwell.functions import rasters as R
from sortwell.functions.vectors import average_hash
from sortwell.operators import report
from sortwell.plans import app, detect
from sortwell.sources import files


def png(m):
    m = np.asarray(m, np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in m)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", m.shape[1], m.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def gray3(m):
    return np.repeat(np.asarray(m)[:, :, None], 3, axis=2)


FLAT = gray3(np.full((40, 40), 127))
HALF = gray3(np.where(np.arange(40)[None] < 20, 0, 255).repeat(40, axis=0))
CHECKER = gray3((np.indices((40, 40)).sum(0) % 2) * 255)
SMALL = gray3(np.full((10, 10), 200))


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    noise = np.random.default_rng(3).integers(0, 256, (48, 48, 3))
    near = noise.copy()
    near[0, 0] = 255 - near[0, 0]
    sets = {
        "train/leaf": {"flat.png": png(FLAT), "half.PNG": png(HALF), "copy.png": png(HALF), "noise.png": png(noise), "notes.txt": b"x", "broken.png": b"no image"},
        "test/leaf": {"half.PNG": png(CHECKER), "near.png": png(near), "small.png": png(SMALL)},
        "test/root": {"a.png": png(CHECKER)},
    }
    for folder, content in sets.items():
        (top / folder).mkdir(parents=True)
        for name, data in content.items():
            (top / folder / name).write_bytes(data)
    return {"train": str(top / "train"), "test": str(top / "test")}


def test_scan_and_inventory(spark, roots):
    found = files.scan_folders(spark, roots)
    assert {(r.split, r.label, r.file_name) for r in found.collect() if r.label == "root"} == {("test", "root", "a.png")}
    assert [(r.label, r.train, r.test, r.text) for r in report.label_inventory(found).collect()] == [("leaf", 5, 3, "leaf (Train: 5, Test: 3)"), ("root", 0, 1, "root (Train: 0, Test: 1)")]
    assert files.scan_folders(spark, roots, label="root").count() == 1
    valid = {r.path.rsplit("/", 1)[1]: r.valid for r in files.valid_images(files.read_images(spark, roots["train"] + "/leaf")).collect()}
    assert valid["flat.png"] and not valid["broken.png"]


def test_measures(spark, roots):
    rows = {r.path.rsplit("/", 1)[1]: r for r in R.image_measures(files.read_images(spark, roots["train"] + "/leaf")).withColumn("phash", average_hash(F.col("thumb"))).collect()}
    flat, half, broken = rows["flat.png"], rows["half.PNG"], rows["broken.png"]
    assert flat.sharpness == 0 and flat.resolution == 1600 and np.allclose(flat.thumb, 127) and flat.phash == "0" * 64
    assert half.phash == "00001111" * 8 and abs(half.sharpness - 255 / 39 / 2) < 1e-9
    assert len(half.histogram) == 96 and abs(sum(half.histogram) - 3) < 1e-9 and half.histogram[0] == 0.5
    assert broken.thumb is None and broken.histogram is None


def test_thumbnails_of_any_size():
    m = np.arange(30.0).reshape(5, 6)
    assert len(R.thumbnail(m)) == 64 and R.thumbnail(np.full((1, 1), 7.0)) == [7.0] * 64
    big = np.random.default_rng(1).random((64, 80))
    assert np.allclose(np.reshape(R.thumbnail(big), (8, 8)), big.reshape(8, 8, 8, 10).mean(axis=(1, 3)))


def test_run(spark, roots, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"train_ratio": 0.5, "duplicate_resolution": {"near_duplicate_threshold": 0.999}, "content_filtering": {"enable_content_filtering": True}}))
    out = tmp_path / "out"
    app.main(["--train", roots["train"], "--test", roots["test"], "--output", str(out), "--config", str(config), "--copy"])
    manifest = spark.read.parquet(str(out / "manifest")).collect()
    leaf = [r for r in manifest if r.label == "leaf"]
    assert len({r.file_hash for r in leaf}) == len(leaf) and {r.split for r in leaf} <= {"train", "test"}
    for r in manifest:
        assert (out / r.split / r.label / r.target_name).exists()
    lines = lambda *at: [json.loads(x) for f in out.joinpath(*at).glob("part-*") for x in f.read_text().splitlines()]
    reports = {x["label"]: x for x in lines("split_analysis", "summary")}
    assert sum(x["verification"]["total_output_count"] for x in reports.values()) == len(manifest)
    assert reports["leaf"]["processing_summary"]["images_copied"] == len(leaf) and reports["leaf"]["settings"]["embedding_method"] == "histogram"
    assert {x["label"] for x in lines("split_analysis", "groups")} == {"leaf"}
    ranked = lines("evaluation")
    assert {(x["label"], x["place"]) for x in ranked} == {(k, n) for k in ("leaf", "root") for n in range(1, 6)}


def test_run_keeps_near_duplicates_as_intended(spark):
    v = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0]]
    rows = [("a", i, f"h{i % 3}", f"{i % 3:064b}" if i else f"{0:064b}", x, i / 10) for i, x in enumerate(v)]
    f = spark.createDataFrame(rows, "label string, idx long, file_hash string, phash string, v array<double>, quality double")
    f = f.withColumn("phash", F.when(F.col("idx") == 2, "1" * 64).when(F.col("idx") == 1, "01" * 32).otherwise("0" * 64))
    for keep, left in ((True, [1, 2, 3]), (False, [2, 3])):
        s = files.Settings(keep_near_duplicates=keep)
        groups = detect.detect_groups(f, s, levels="intended")
        assert sorted((r.kind, r.idx) for r in groups.collect()) == [("exact", 0), ("exact", 3), ("near", 0), ("near", 1), ("near", 3)]
        assert sorted(r.idx for r in detect.kept_items(f, groups, s).collect()) == left
    assert sorted(r.idx for r in detect.kept_items(f, detect.detect_groups(f, s), s).collect()) == [2, 3]
    mixed = f.withColumn("embedding_method", F.when(F.col("idx") == 1, "x").otherwise("y"))
    assert {(r.i, r.j) for r in detect.vector_edges(mixed, 0.9).collect()} == {(0, 3)}


def test_manifest_names(spark):
    rows = [("train", "a.png", "h1", 0), ("train", "a.png", "h1", 1), ("train", "a.png", "h2", 2), ("train", "a_1.png", "h3", 3), ("test", "a.png", "h2", 4)]
    got = report.copy_manifest(spark.createDataFrame(rows, "split string, file_name string, file_hash string, idx long")).collect()
    assert sorted((r.split, r.idx, r.target_name) for r in got) == [("test", 4, "a.png"), ("train", 0, "a.png"), ("train", 2, "a_2.png"), ("train", 3, "a_1.png")]
    moved = report.moved(spark.createDataFrame([("train", "x"), ("train", "y")], "split string, path string"), "x").collect()
    assert sorted(map(tuple, moved)) == [("test", "x"), ("train", "y")]


def test_settings(tmp_path):
    assert files.load_json(str(tmp_path / "none.json")) == {}
    (tmp_path / "bad.json").write_text("{")
    assert files.load_json(str(tmp_path / "bad.json")) == {}
    files.save_json(str(tmp_path / "s.json"), {"similarity_threshold": 0.9, "train_ratio": 0.7})
    s = files.settings_from(files.load_json(str(tmp_path / "s.json")))
    assert (s.near_duplicate_threshold, s.train_ratio, round(s.test_ratio, 9)) == (0.9, 0.7, 0.3)
    with pytest.raises(ValueError):
        files.settings_from({"train_ratio": 1.5})


def test_recount(spark):
    a = spark.createDataFrame([("train",), ("train",), ("test",)], "split string")
    got = {r.split: r.matches for r in report.recount(a, a.where("split = 'train'")).collect()}
    assert got == {"train": True, "test": False}


def test_models_in_a_chain(spark, roots):
    """What one model fails on goes to the next, and one that can't be made is passed over."""

    def missing():
        raise ImportError("no such library")

    def first():
        def run(rasters):
            if any(m.shape[0] < 40 for m in rasters):
                raise ValueError("too small")
            return np.stack([[m.mean() + 1, 1.0] for m in rasters])

        return run

    def second():
        def run(rasters):
            if any(m.std() == 0 for m in rasters):
                raise ValueError("flat")
            return np.stack([[1.0, 2.0, 2.0] for m in rasters])

        return run

    from sortwell.functions.embedding import embed_chain

    images = files.read_images(spark, [roots["train"] + "/leaf", roots["test"] + "/leaf"])
    tiny = images.where("path LIKE '%small.png'").withColumn("path", F.lit("x/tiny.png")).withColumns({"height": F.lit(2), "width": F.lit(1), "data": F.unhex(F.lit("000000ffffff"))})
    rows = {r.path.rsplit("/", 1)[1]: r for r in embed_chain(images.unionByName(tiny), {"missing": missing, "first": first, "second": second}).collect()}
    assert {k: r.embedding_method for k, r in rows.items() if k in ("flat.png", "noise.png", "small.png", "tiny.png", "broken.png")} == {"flat.png": "first", "noise.png": "first", "small.png": "histogram", "tiny.png": "second", "broken.png": None}
    assert np.allclose(rows["tiny.png"].embedding, [1 / 3, 2 / 3, 2 / 3]) and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in rows.values() if r.embedding)


def test_embedding(spark, roots):
    def load():
        def model(batch):
            if any(m.shape[0] == 48 for m in batch):
                raise ValueError("too large")
            return np.stack([m.reshape(-1, 3).mean(axis=0) for m in batch])

        return model

    from sortwell.functions.embedding import embed

    rows = {r.path.rsplit("/", 1)[1]: r for r in embed(files.read_images(spark, roots["train"] + "/leaf"), load, "mean").collect()}
    assert np.allclose(rows["flat.png"].embedding, [3**-0.5] * 3, atol=1e-6) and rows["flat.png"].embedding_method == "mean"
    assert len(rows["noise.png"].embedding) == 96 and rows["noise.png"].embedding_method == "histogram"
    assert rows["broken.png"].embedding is None
