"""Positions within a label: a row number that no single task has to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortwell.session import settle


def with_position(df: DataFrame, key: str, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` plus ``name``, the rows' 0-based place in ``order`` within ``key``.

    Rows are dealt by ranges of key and order, so a large label spans tasks. A row's
    place is its place in its task less the label's first one there, plus the label's
    rows in earlier tasks; only one row per label and task is ranked in a window.
    ``order`` has to be total for a repeatable result.
    """
    ranges = [F.col(key).asc_nulls_first(), *order]
    dealt = settle(
        df.repartitionByRange(*ranges).sortWithinPartitions(*ranges).withColumn("_pos", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id()),
        "ordered",
    )
    runs = dealt.groupBy(F.col(key).alias("_key"), F.col("_task").alias("_in")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        dealt.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_task") == F.col("_in")))
        .withColumn(name, F.col("_pos") - F.col("_first") + F.col("_before"))
        .drop("_pos", "_task", "_key", "_in", "_first", "_n", "_before")
    )
