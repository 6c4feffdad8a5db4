"""Thresholds, windows, components and rotations on grids against plain restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortwell.functions.vectors import canonical_rotation, rotations
from sortwell.operators.grids import grid_components, gridded, two_class_threshold, windowed_spread


def test_threshold(spark):
    r = random.Random(1)
    rows = [(k, b, r.randint(0, 9)) for k in ("a", "b", None) for b in range(-3, 12) if r.random() < 0.8] + [("one", 4, 7), ("tie", 0, 5), ("tie", 1, 0), ("tie", 2, 5), ("a", 3, 2)]
    got = {x.k: x for x in two_class_threshold(spark.createDataFrame(rows, "k string, bin long, n long"), "k").collect()}
    for k in {x[0] for x in rows}:
        values = sorted(b for key, b, n in rows if key == k for _ in range(n))
        bins = sorted({b for key, b, _ in rows if key == k})
        within = {}
        for t in bins:
            low, high = [v for v in values if v <= t], [v for v in values if v > t]
            if low and high:
                within[t] = sum((v - sum(c) / len(c)) ** 2 for c in (low, high) for v in c)
        if not within:
            assert got[k].threshold is None and (got[k].below, got[k].above) == (len(values), 0)
            continue
        best = min(within.values())
        assert abs(within[got[k].threshold] - best) < 1e-9 and got[k].threshold == min(t for t, v in within.items() if abs(v - best) < 1e-9)
        assert got[k].below == sum(v <= got[k].threshold for v in values) and got[k].above == len(values) - got[k].below
        assert abs(got[k].between * len(values) + best - sum((v - sum(values) / len(values)) ** 2 for v in values)) < 1e-6 * len(values)
    assert two_class_threshold(spark.createDataFrame([], "k string, bin long, n long"), "k").count() == 0


def grids(seed, n, height, width):
    return np.random.default_rng(seed).integers(0, 256, (n, height, width))


@pytest.mark.parametrize("size,step", [(4, 2), (3, 1), (8, 8)])
def test_windows(spark, size, step):
    g = grids(2, 12, 8, 10)
    df = gridded(spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(g)], "id long, v array<int>"), "id", "v", 10)
    got = {x.id: x for x in windowed_spread(df, "id", size, step).collect()}
    for i, m in enumerate(g):
        std = [m[r : r + size, c : c + size].std() for r in range(0, 8 - size, step) for c in range(0, 10 - size, step)]
        assert got[i].windows == len(std)
        assert math.isclose(got[i].spread, min(1.0, sum(std) / len(std) / 50) if std else 0.5)


def test_components_of_grids(spark):
    g = grids(3, 30, 9, 11)
    g[0] = 0
    g[1] = 255
    df = gridded(spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(g)], "id long, v array<int>"), "id", "v", 11)
    for least in (0, 4):
        got = {x.id: (x.components, x.largest) for x in grid_components(df, "id", "x > 170", least).collect()}
        for i, m in enumerate(g):
            left, sizes = {(r, c) for r, c in zip(*np.nonzero(m > 170))}, []
            while left:
                todo, n = [left.pop()], 0
                while todo:
                    r, c = todo.pop()
                    n += 1
                    near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                    left -= near
                    todo += near
                sizes.append(n)
            sizes = [n for n in sizes if n > least]
            assert got[i] == (len(sizes), max(sizes, default=0))


def test_rotations(spark):
    r = random.Random(4)
    m = np.array([r.randrange(2) for _ in range(64)]).reshape(8, 8)
    text = lambda x: "".join(map(str, x.ravel()))
    want = [text(np.rot90(m, -k)) for k in range(4)]
    df = spark.createDataFrame([(t,) for t in want] + [(None,), ("01",)], "h string")
    rows = df.select("h", rotations(F.col("h")).alias("r"), canonical_rotation(F.col("h")).alias("c")).collect()
    assert rows[0].r == want and {x.c for x in rows[:4]} == {min(want)} and rows[4].c is None and rows[5].c is None


@pytest.mark.parametrize("name", ["grid_parts", "image_levels", "image_measures", "ssim_neighbours"])
def test_gray_levels_are_taken_in_single_precision(spark, tmp_path, name):
    """Levels that are halves in single precision, but not in double, are rounded as the SQL does."""
    import duckdb

    from sortwell.oracles import ORACLES
    from sortwell.queries import queries

    level = lambda x: np.float32(x) * np.float32(300) + np.float32(128)
    odd = next(x for x in np.linspace(0.0415, 0.0418, 20001).astype(np.float32) if level(x) == 140.5 and float(x) * 300 + 128 < 140.5)
    r = np.random.default_rng(3)
    plain = r.uniform(-0.3, 0.3, (4, 64)).astype(np.float32)
    part = np.full((4, 64), -0.1, np.float32)
    part[:, [9, 10, 17, 18]] = odd  # four bright cells by halves
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate([*plain, *part, *r.permuted(part, axis=1)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries()[name](spark, str(tmp_path))
    want = con.sql(ORACLES[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
