"""The rows that a dedup stage keeps, decided by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortwell.session import settle

#: Rows of a lookup that is broadcast, counted before (about 100 bytes each); beyond it Spark joins by a shuffle.
LOOKUP_ROWS = 200_000


def one_of_each(docs: DataFrame, id_col: str, text_col: str, sketch: Callable[[Column], Column], key: Callable[[Column], Column], gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``id, sketch, key`` in ``gone``, and one row of each in ``repeated``.

    ``key`` tells texts apart among rows that share an id, null ids included. It is computed only
    for rows whose ``id`` and ``sketch``, a cheap function of the text, are met. Of
    rows that share all the least as JSON text stays; only such rows are grouped. All
    columns are kept, whatever their names. Up to ``LOOKUP_ROWS`` of them are looked up
    where the texts are; more of them are joined by a shuffle, which moves the texts
    once. Either way gives the same rows.
    """
    names = ["id", "sketch", "key"]
    repeated = settle(repeated.select(names), "repeated")
    away = settle(gone.select(names).union(repeated).toDF("gone_id", "gone_sketch", "gone_key"), "gone")
    found = away.count()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), sketch(F.col(text_col)).alias("sketch"))
    own = key(F.col("row").getField(text_col))
    look = lambda side, n: F.broadcast(side) if n <= LOOKUP_ROWS else side
    # not an equality to join by: then every row would compute its key
    met = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sketch") == F.col("gone_sketch")) & F.coalesce(own == F.col("gone_key"), F.lit(False))
    single = rows.join(look(away, found), met, "left_anti").select("row.*")
    more = repeated.count()
    if not more:
        return single
    again = rows.join(look(repeated.toDF("gone_id", "gone_sketch", "gone_key"), more), met, "left_semi").withColumn("key", own)
    return single.union(again.groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
