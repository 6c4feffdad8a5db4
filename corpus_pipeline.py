"""A corpus pipeline: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and reread as the next one's ``docs``. All but the last return the columns
of ``docs``, whatever their names.

Nulls in any column are values: null texts are empty, a null source is a source, a null id
is an id without a label. Texts are read whole, however long. Empty tables give
empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sortwell.llm import bpe, cnn, exact_dedup, mixing, simhash
from sortwell.session import release, settle, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labels as in its own query.

    Empty texts have no evidence and stay. Repeated rows are decided alike. Without
    labels of both values nothing goes.
    """
    scored = cnn.toxicity(spark, docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays, of repeated rows one; all empty texts are equal."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays, of repeated rows one; texts without words are one group."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at its source's cut gives the missing words.

    Rows without words are taken as often as their source's documents, at most twice;
    repeated rows and equal places in the order are taken each.
    """
    return mixing.materialise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and texts of all rows, as counts and digests, a row for each; empty texts have no ids."""
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The first and the last stage can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
            if n:
                release(before)
    return docs
