"""Token counts: an exact length histogram with suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortwell.llm.arrow import sliced
from sortwell.llm.bpe import coder
from sortwell.session import evenly, map_arrow, settle, table

#: Lengths in a band; suffix sums run within bands, and once over the bands.
BAND = 64


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``n_tokens`` of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(c.encode(t.as_py() or "")) for t in batch.column(0)], pa.int64())], names=["n_tokens"])

    return map_arrow(docs.select(F.col(text_col).alias("text")), run, "n_tokens long")


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row per distinct encoded length: ``n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_total``.

    ``docs_at_least`` and ``tokens_at_least`` are suffix sums over the lengths from
    this one up; ``truncated_total`` is what is left of all tokens when every document
    is cut to this length. Lengths are counted where they arise before anything is
    shuffled. Suffix sums run per band of lengths plus the sums of the bands above, so
    no task orders the whole histogram. Null and empty texts count with length 0;
    repeated rows count each; an empty table gives no rows.
    """
    hist = settle(token_lengths(docs, path, text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")
    banded = hist.withColumn("band", F.floor(F.col("n_tokens") / BAND))
    tokens = F.col("n_tokens") * F.col("n_docs")
    above = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        banded.groupBy("band")
        .agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
        .select("band", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    )
    upward = Window.partitionBy("band").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        banded.withColumn("docs_in", F.sum("n_docs").over(upward))
        .withColumn("tokens_in", F.sum(tokens).over(upward))
        .join(bands, "band")
        .select("n_tokens", "n_docs", (F.col("docs_in") + F.col("docs_above")).alias("docs_at_least"), (F.col("tokens_in") + F.col("tokens_above")).alias("tokens_at_least"), "all_tokens")
        .withColumn("truncated_total", F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .drop("all_tokens")
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, total, docs_cut``: tokens left when documents are cut to each limit, from the suffix sums.

    One pass over the histogram, whatever the limits. A limit above all lengths leaves
    all tokens; an empty histogram gives zeros.
    """
    one = []
    for limit in limits:
        first = F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
        one.append(F.struct(F.lit(limit).cast("long").alias("limit"), first.alias("first"), F.max(F.when(F.col("n_tokens") > limit, F.col("docs_at_least"))).alias("docs_cut")))
    all_tokens = F.coalesce(F.max("tokens_at_least"), F.lit(0))
    row = histogram.agg(all_tokens.alias("all_tokens"), F.array(*one).alias("limits")).select("all_tokens", F.inline("limits"))
    total = F.col("all_tokens") - F.coalesce("first.tokens_at_least", F.lit(0)) + F.col("limit") * F.coalesce("first.docs_at_least", F.lit(0))
    return row.select("limit", total.alias("total"), F.coalesce("docs_cut", F.lit(0)).alias("docs_cut"))


def length_quantiles(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """``quantile, n_tokens``: the least length that a share of at least ``quantile`` of the documents does not exceed.

    Documents of equal length are one step. An empty histogram gives null.
    """
    n = histogram.agg(F.max("docs_at_least")).first()[0] or 0
    up_to = F.lit(n) - F.col("docs_at_least") + F.col("n_docs")
    found = [F.struct(F.lit(float(q)).alias("quantile"), F.min(F.when(up_to >= float(q) * n, F.col("n_tokens"))).alias("n_tokens")) for q in quantiles]
    return histogram.agg(F.array(*found).alias("q")).select(F.inline("q"))


def op1_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(evenly(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
