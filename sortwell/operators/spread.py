"""Group statistics joined back to rows without putting a hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sub-keys of a group; at most 63, since a group notes those in use as bits of a long.
SPREAD = 32


def with_group(rows: DataFrame, keys: list[str], aggs: dict[str, Column], spread_on: str, at_least: int = 2, ways: int = SPREAD) -> DataFrame:
    """``rows`` plus the columns of ``aggs`` and ``group_n`` over ``keys``, left-joined.

    Only groups of ``at_least`` rows are looked up; other rows get nulls. Rows of a
    group are dealt to ``ways`` sub-keys by a hash of ``spread_on``, and a group's
    statistics are repeated only for the sub-keys in which it has rows, so no task
    receives a whole hot group and the lookup side never exceeds the input.
    Null keys compare equal.
    """
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(F.col(spread_on)), F.lit(ways)).cast("int"))
    named = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    groups = (
        dealt.groupBy(*[c.alias(n) for n, c in named.items()])
        .agg(F.count(F.lit(1)).alias("group_n"), F.bit_or(F.expr("shiftleft(1L, _way)")).alias("_ways"), *[a.alias(n) for n, a in aggs.items()])
        .where(F.col("group_n") >= at_least)
        .withColumn("_at", F.explode(F.expr(f"filter(sequence(0, {ways - 1}), i -> getbit(_ways, i) = 1)")))
        .drop("_ways")
    )
    match = F.col("_way") == F.col("_at")
    for n, k in zip(named, keys, strict=True):
        match = match & F.col(k).eqNullSafe(F.col(n))
    return dealt.join(groups, match, "left").drop("_way", "_at", *named)
