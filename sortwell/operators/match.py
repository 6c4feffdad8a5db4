"""Joins in which a null key is a key like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)``, but nulls of the columns ``on`` equal each other.

    Inner, left, semi and anti joins; the result has the columns ``on`` from the left.
    """
    named = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(named, match, how).drop(*[f"_on_{c}" for c in on])
