"""Token vectors, and what links of vectors cost."""

import hashlib
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from sortwell.functions import vectors
from sortwell.operators.runs import groups_within
from sortwell.queries import rounded


def plain(text):
    if text is None:
        return None
    out = [0.0] * 64
    for t in text.split(" "):
        out[hashlib.md5(t.encode()).digest()[0] % 64] += 1
    return out


def test_token_vectors_of_odd_texts(spark, monkeypatch):
    r = random.Random(1)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\tb\nc d", "ä ö   　x", "\x00 \x00", "x" * 5000, None] + [" ".join(r.choice(["", "of", "the", "ß", "語"]) for _ in range(r.randint(1, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "id long, text string, more int").repartition(2)
    for size in (8 << 20, 64, 1):
        monkeypatch.setattr(vectors, "SLICE_BYTES", size)
        got = vectors.with_token_vector(df)
        assert got.columns == ["id", "more", "v"]
        assert {x.id: (x.more, x.v) for x in got.collect()} == {i: (i % 7, plain(t)) for i, t in enumerate(texts)}
    assert vectors.with_token_vector(df.where("id < 0")).count() == 0


def test_repeated_tokens_cost_less_than_their_digests(spark):
    """Each different token of a slice is hashed once, so counting takes less than hashing every token."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("word"), (F.col("id") * i % 997).cast("string"))), " ")
    df = spark.range(0, 2000, 1, 4).select("id", text.alias("text")).cache()
    df.count()
    digests = df.select(F.aggregate(F.transform(F.split("text", " "), F.md5), F.lit(0), lambda s, h: s + F.length(h)).alias("n"))
    counts = vectors.with_token_vector(df).select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("n"))
    took = {}
    for name, rows in (("digests", digests), ("counts", counts)):
        rows.agg(F.sum("n")).collect()
        begun = time.time()
        rows.agg(F.sum("n")).collect()
        took[name] = time.time() - begun
    df.unpersist()
    assert took["counts"] < took["digests"], took


def test_groups_of_a_batch_that_is_not_sorted():
    batch = pa.RecordBatch.from_pydict({"label": ["b", None, "a", "b", None, "a", "b"], "dim": [2, 1, 1, 1, 1, 1, 2], "idx": list(range(7))})
    got = sorted(sorted(t["idx"].to_pylist()) for t in groups_within(batch, ["label", "dim"]))
    assert got == [[0, 6], [1, 4], [2, 5], [3]]
    assert list(groups_within(batch.slice(0, 0), ["label"])) == []


def test_six_places_are_those_of_round(spark):
    r = random.Random(2)
    sims = [r.uniform(0.3, 1) for _ in range(3000)] + [k / 2e6 for k in range(700_001, 2_000_000, 997)] + [1.0]
    df = spark.createDataFrame([(x,) for x in sims], "sim double")
    assert df.where(rounded() != F.round(F.col("sim") * 1e6) / 1e6).count() == 0
