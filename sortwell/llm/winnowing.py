"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortwell.llm.arrow import sliced, spans
from sortwell.llm.sieve import gram_hashes, passes, sieve
from sortwell.session import evenly, map_arrow, settle, table

#: Words of a window, and of the k-grams of which each window keeps the least. A window holds WINDOW - GRAM + 1 of them.
WINDOW, GRAM = 10, 5
#: Words whose hashes a task remembers.
KNOWN = 1 << 18
#: Fingerprints of the benchmark that are broadcast, counted before (about 300 bytes each); beyond, both sides are shuffled.
LOOKUP_ROWS = 50_000

#: Bytes of words are 0-9, A-Z, a-z and those of other characters than ASCII.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")

_PRINT = pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
_HITS = "array<struct<size int, hash long, pos long, gram string, before array<string>, after array<string>>>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORDS).split()


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places that are the least of some ``width`` neighbours, of equal ones the last."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for k in range(1, width):
        np.minimum(least, hashes[k : k + n], out=least)
    chosen, open_ = np.zeros(len(hashes), bool), np.ones(n, bool)
    for k in reversed(range(width)):
        hit = open_ & (hashes[k : k + n] == least)
        chosen[k : k + n] |= hit
        open_ &= ~hit
    return np.flatnonzero(chosen)


def _prints(words: list[bytes], h: np.ndarray, base: int, sizes: list[int], bits: np.ndarray | None) -> Iterator[tuple]:
    """Fingerprints as ``size, hash, pos, gram, before, after``.

    ``size`` 0 marks a k-gram with its neighbours, nearest first, that share a window
    with it; another size a whole short item. ``bits`` sifts.
    """
    grams = gram_hashes(h, GRAM)
    at = winnow(grams, WINDOW - GRAM + 1)
    for size, places, hashes in [(0, at, grams[at]), *((s, None, gram_hashes(h, s)) for s in sizes)]:
        places = np.arange(len(hashes)) if places is None else places
        if bits is not None:
            stay = passes(bits, hashes)
            places, hashes = places[stay], hashes[stay]
        reach, long = (0, size) if size else (WINDOW - GRAM, GRAM)
        for p, x in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
            yield size, x, base + p, b" ".join(words[p : p + long]), words[max(0, p - reach) : p][::-1], words[p + long : p + long + reach]


def prints(texts: DataFrame, id_col: str, text_col: str, sizes: list[int] | None = None, bits: np.ndarray | None = None) -> DataFrame:
    """``id, n_words, prints`` of each row; a null text has no words.

    Long texts are read in spans that overlap by a window less a word, so every window
    lies in one. Without ``sizes`` a text of fewer words than a window is one whole
    fingerprint; with them, runs of these lengths are looked for everywhere.
    """
    id_type = texts.schema[id_col].dataType.simpleString()
    held = texts.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        sift = held.value if held is not None else None
        for batch in sliced(batches):
            n_words, ends, found = [], [0], []
            for value in batch.column(1).cast(pa.binary()):
                n, tail = 0, []
                for span in spans(value.as_py() or b"", _GAP):
                    fresh = words_of(span)
                    words = tail + fresh
                    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    short = sizes if sizes is not None else [len(words)] if 0 < len(words) < WINDOW and not n else []
                    found += _prints(words, h, n - len(tail), short, sift)
                    n += len(fresh)
                    tail = words[1 - WINDOW :]
                n_words.append(n)
                ends.append(len(found))
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found, strict=True)) or [[]] * 6, _PRINT, strict=True)], fields=list(_PRINT))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["id", "n_words", "prints"])

    return map_arrow(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {id_type}, n_words long, prints {_HITS}")


def _agree(a: str, b: str) -> Column:
    """How many leading entries of two arrays agree."""
    shared = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared), lambda x, y: x == y), False)
    return F.when(first == 0, shared).otherwise(first.cast("int") - 1)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents as ``row, id, n_words``, and ``row, item, start, end``: words that lie in an occurrence of a window of an item.

    ``row`` numbers the documents, so rows that repeat an id stay apart. A window is
    ``WINDOW`` words of an item, or a whole shorter one. Each window keeps the
    least of its k-gram hashes, in documents and items alike, so a shared window always
    shares a fingerprint. Documents' fingerprints pass a bounded sieve of those of the
    benchmark, then join the real ones; the words of k-gram and neighbours are compared
    and the hit extends as far as they agree. No hash decides by itself.

    A null item id is an item named by the empty text. Items that repeat count once.
    """
    items = settle(prints(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")), "item", "text").select("id", F.inline("prints")), "item-prints")
    theirs = settle(items.select(F.col("id").alias("item"), "size", "hash", F.col("gram").alias("their_gram"), F.col("before").alias("their_before"), F.col("after").alias("their_after")).distinct(), "benchmark")
    sizes = sorted(r[0] for r in theirs.select("size").distinct().collect() if r[0])  # fewer than WINDOW
    n = theirs.count()
    bits = sieve(theirs.select(F.col("hash").alias("h")), n)
    rows = settle(prints(docs, id_col, text_col, sizes, bits).withColumn("row", F.monotonically_increasing_id()), "prints")
    hits = rows.select("row", F.inline("prints")).join(F.broadcast(theirs) if n <= LOOKUP_ROWS else theirs, ["size", "hash"]).where(F.col("gram") == F.col("their_gram"))
    left, right, long = _agree("before", "their_before"), _agree("after", "their_after"), F.when(F.col("size") > 0, F.col("size")).otherwise(GRAM)
    found = hits.select("row", "item", "size", (F.col("pos") - left).alias("start"), (F.col("pos") + long + right).alias("end"))
    spans_ = found.where((F.col("size") > 0) | (F.col("end") - F.col("start") >= WINDOW)).select("row", "item", "start", "end").distinct()
    return rows.select("row", "id", "n_words"), settle(spans_, "overlaps")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, n_items, items, contaminated``.

    ``n_hit`` counts words inside any occurrence of a window, each once; ``items`` are
    the sorted ids of the items met, as strings. Null and empty texts have no words
    and hit nothing; rows that repeat are reported each; an empty table on either side
    hits nothing. Other columns are not read, whatever their names. See ``overlaps``.
    """
    rows, spans_ = overlaps(docs, benchmark, id_col, text_col, item_col, item_text)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = spans_.select("row", "start", "end").distinct().select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach)).alias("fresh"))
    hit = fresh.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    met = spans_.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hit.join(met, "row").withColumnRenamed("row", "of")
    n = F.coalesce("n_hit", F.lit(0))
    return rows.join(found, F.col("row") == F.col("of"), "left").select(
        F.col("id").alias(id_col), "n_words", n.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n > 0).alias("contaminated")
    )


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(evenly(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP11_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, m, array_to_string(w[s : s + m - 1], ' ') AS gram
    FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)
), grams AS (
    SELECT r, s, m, array_to_string(w[s : s + m - 1], ' ') AS gram
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM texts, (SELECT DISTINCT m FROM windows))
), hits AS (
    SELECT r, s, m, item FROM grams JOIN windows USING (m, gram)
), hit_words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT r, s, m FROM hits)) GROUP BY r
), hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
