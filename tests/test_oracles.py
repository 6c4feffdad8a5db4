"""Queries against their SQL in DuckDB."""

import math

import duckdb
import pytest

from sortwell.oracles import ORACLES
from sortwell.queries import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "flagship_dedup_split", "label_inventory", "counters_pct", "name_truncate", "name_sort", "path_parse", "text_lines", "progress_log", "config_defaults", "file_hash_groups", "hamming_pairs", "cosine_pairs_semantic", "embedding_pairs",
    "leader_groups_semantic", "keep_best", "best_image_score", "quality_composite", "vector_histograms", "classify_content", "kfold_metrics", "split_report", "copy_manifest", "run_totals", "image_levels", "image_measures", "ssim_neighbours", "split_rebalance",
    "settings_merge", "price_histogram", "group_report", "verify_cross_split", "unique_keeping_near", "output_recount", "name_lookup", "move_report", "run_lines", "run_report",
    "basket_pairs", "class_threshold", "grid_texture", "grid_parts", "rotated_groups", "manifest_versions", "config_comparison",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    got = queries()[name](spark, DIR)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    b = sorted(repr([plain(dict(zip(want.columns, r, strict=True))[c]) for c in cols]) for r in want.fetchall())
    assert a == b
