"""Exact dedup by progressive refinement: length, then prefix hash, then full hash (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.llm.keep import one_of_each
from sortwell.operators.spread import with_group
from sortwell.session import release, settle, table

#: Characters of the normalised text that the prefix hash covers.
PREFIX = 256
#: The sieve of surviving prefixes: at most so many slots of so many words of 64 bits, 16 MB.
SLOTS, SLOT_WORDS = 1 << 17, 16


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _sketch(text: Column, prefix: int = PREFIX) -> Column:
    """Length and prefix of the normalised text as one hash."""
    t = normalised(text)
    return F.xxhash64(F.octet_length(t).cast("long"), F.xxhash64(F.substring(t, 1, prefix)))


def _place(sketch: str) -> list[Column]:
    """Slot, word and bit of a hash in the sieve."""
    high = F.shiftrightunsigned(F.col(sketch), 6)
    return [F.pmod(high, F.lit(SLOTS)), F.pmod(F.shiftrightunsigned(high, SLOTS.bit_length() - 1), F.lit(SLOT_WORDS)), F.col(sketch).bitwiseAND(F.lit(63)).cast("int")]


def _sieve(sketches: DataFrame) -> DataFrame:
    """``at, words`` of the distinct hashes ``sketch``: a map from word to bits for each slot in use, so a bounded table."""
    at, word, bit = _place("sketch")
    words = sketches.select(at.alias("at"), word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("at", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256, sketch``.

    Rows are equal when their normalised texts are identical; of equal rows the one
    with the smallest id stays. The grouping narrows in three steps, each over the
    survivors of the one before: rows whose length another row shares, of these the
    rows whose prefix hash another shares, of these the rows whose SHA-256 another
    shares. Only ids, lengths and hashes are shuffled, never texts, and rows of a
    hot group are spread over sub-keys by a number of their own, also where ids are null or repeat.

    The surviving prefixes go to the texts as a sieve of bounded size, at any number of
    them; it stops no survivor, and who passes without a partner finds none by SHA-256.
    Rows that are stopped are not hashed in full and have a null ``text_sha256``;
    ``digest_all`` fills theirs too. ``sketch`` is a hash of length and prefix.

    Null and empty texts are one group. Rows that repeat an id and a text share one
    decision. A null id sorts after all others and stays only among null ids. Other
    columns are not read. An empty table gives no rows.
    """
    norm = normalised(text_col)
    source = docs.select(F.col(id_col).alias("id"), norm.alias("t")).select("id", F.octet_length("t").cast("long").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("head"), "t")
    first = settle(source.select("len", "head", F.monotonically_increasing_id().alias("spot")), "lengths")
    by_length = with_group(first, ["len"], {}, "spot").where("group_n IS NOT NULL").drop("group_n")
    by_head = with_group(by_length, ["len", "head"], {}, "spot").where("group_n >= 2")
    sieve = settle(_sieve(by_head.select("len", "head").distinct().select(F.xxhash64("len", "head").alias("sketch"))), "heads")
    release(first)

    marked = source.withColumn("sketch", F.xxhash64("len", "head"))
    at, word, bit = _place("sketch")
    passed = F.coalesce(F.call_function("getbit", F.element_at("words", word), bit) == 1, F.lit(False))
    narrow = marked.join(F.broadcast(sieve), at == F.col("at"), "left").select("id", "sketch", passed.alias("survives"), "t")
    digest = F.sha2("t", 256)
    hashed = settle(narrow.select("id", "sketch", "survives", (digest if digest_all else F.when(F.col("survives"), digest)).alias("sha"), F.monotonically_increasing_id().alias("spot")), "digests")
    same = with_group(hashed.where("survives"), ["sha"], {"keep": F.min("id")}, "spot")
    alone = hashed.where("NOT survives").select("id", "sketch", "sha", F.lit(None).cast("long").alias("group_n"), F.lit(None).cast(hashed.schema["id"].dataType).alias("keep"))
    return (
        same.select("id", "sketch", "sha", "group_n", "keep")
        .unionByName(alone)
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("group_n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("group_n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("group_n").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
            "sketch",
        )
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True).drop("sketch")


OP6_SQL = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each normalised text, of the smallest id, with all its columns.

    Null and empty texts are one text. Of rows that repeat an id and a text one stays;
    an id with two texts is decided for each; a null id stays only where all ids of a
    text are null. Columns keep their names, also those used in here. An empty table
    gives no rows. Only texts that share length and prefix with another are hashed in
    full, and once more those whose id and prefix are among what goes; see
    ``one_of_each`` for when texts are moved.
    """
    pairs = exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("id"), "sketch", F.col("text_sha256").alias("key"), "kept", "group_size").where("group_size > 1")
    pairs = settle(pairs.groupBy("id", "sketch", "key", "kept").agg(F.count(F.lit(1)).alias("copies")), "pairs")
    return one_of_each(docs, id_col, text_col, _sketch, lambda t: F.sha2(normalised(t), 256), pairs.where("NOT kept"), pairs.where("kept AND copies > 1"))
