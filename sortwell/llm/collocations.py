"""Phrase collocation mining: n-grams from an FM-index of each shard, summed across shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortwell.llm import fm_index
from sortwell.llm.arrow import sliced, spans
from sortwell.llm.sieve import folded, passes, sieve
from sortwell.session import evenly, map_arrow, settle, table

#: Words of a phrase at most, occurrences of a candidate at least, and phrases of a language in the report.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Words of a shard, and rows of a batch that a shard gives out.
SHARD_WORDS, ROWS = 1 << 20, 1 << 16

#: Characters that end a piece, as one of them.
_PIECES = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0d.,;:!?]")
_COUNTS = "lang string, phrase string, size int, n long"


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang))


class _Words:
    """The words of a shard by id; words of two languages are two words. Id 0 ends pieces."""

    def __init__(self) -> None:
        self.names, self.langs, self.by_lang = [b""], [b""], {}

    def ids(self, lang: bytes, tokens: list[bytes]) -> np.ndarray:
        known = self.by_lang.setdefault(lang, {b".": 0})
        for w in set(tokens).difference(known):
            known[w] = len(self.names)
            self.names.append(w)
            self.langs.append(lang)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def __len__(self) -> int:
        return len(self.names)


def _pruned(ids: np.ndarray, known: _Words, least: int, word_bits: np.ndarray | None, pair_bits: np.ndarray | None) -> np.ndarray:
    """``ids`` without what no frequent phrase holds: words and links that a sieve stops end a piece, pieces below ``least`` words go."""
    if word_bits is not None:
        h = np.fromiter(map(_word_hash, known.langs, known.names), np.uint64, len(known))
        stay = passes(word_bits, folded([h]))
        ids = np.where(stay[ids], ids, 0)
        if pair_bits is not None:
            a, b = ids[:-1], ids[1:]
            apart = (a > 0) & (b > 0) & ~passes(pair_bits, folded([h[a], h[b]]))
            ids = np.insert(ids, np.flatnonzero(apart) + 1, 0)
    piece = np.cumsum(ids == 0)  # each begins with its separator
    return np.append(ids[np.bincount(piece)[piece] > least], 0)


def _shard(ids: np.ndarray, known: _Words, sizes: tuple[int, int], sign: int, word_bits: np.ndarray | None, pair_bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    ids = _pruned(np.concatenate([[0], ids]), known, sizes[0], word_bits, pair_bits)
    if len(ids) < 2:
        return
    names, langs = pa.array(known.names, pa.binary()), pa.array(known.langs, pa.binary())
    for found in fm_index.patterns(ids, len(known), sizes[1]):
        if found.words.shape[1] < sizes[0]:
            continue
        for at in range(0, len(found.size), ROWS):
            some = found.words[at : at + ROWS]
            phrase = pc.binary_join_element_wise(*[names.take(pa.array(w)) for w in some.T], b" ")
            lang = langs.take(pa.array(some[:, 0]))
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(some), some.shape[1], np.int32)), pa.array(found.size[at : at + ROWS] * sign)], names=["lang", "phrase", "size", "n"])


def phrase_counts(docs: DataFrame, sizes: tuple[int, int], word_bits: np.ndarray | None = None, pair_bits: np.ndarray | None = None, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, phrase, size, n``: occurrences of all phrases of ``sizes[0]`` to ``sizes[1]`` words that the sieves let through.

    Each task cuts its texts into shards of ``shard_words`` words, whatever the documents' lengths.
    A piece that a shard's end cuts goes on in the next shard with its last words
    repeated; what lies within them is counted off again.
    """
    spark = docs.sparkSession
    held = [spark.sparkContext.broadcast(b) if b is not None else None for b in (word_bits, pair_bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sifts = [b.value if b is not None else None for b in held]
        known, parts, n = _Words(), [], 0
        for batch in sliced(batches):
            for lang, value in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0).cast(pa.binary()), strict=True):
                for span in spans(value.as_py() or b"", _GAP):
                    ids = known.ids(lang, span.lower().translate(_PIECES).replace(b".", b" . ").split())
                    parts.append(ids)
                    n += len(ids)
                    if n >= shard_words:
                        ids = np.concatenate(parts)
                        yield from _shard(ids, known, sizes, 1, *sifts)
                        tail = ids[1 - fm_index.DEPTH :]
                        tail = tail[np.append(np.flatnonzero(tail == 0), -1).max() + 1 :]
                        if len(tail):
                            yield from _shard(tail, known, sizes, -1, *sifts)
                        words, known = [known.names[w] for w in tail], _Words()
                        parts, n = [known.ids(lang, words)], len(words)
                parts.append(np.zeros(1, np.int64))
        if parts:
            yield from _shard(np.concatenate(parts), known, sizes, 1, *sifts)

    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return map_arrow(texts, run, _COUNTS).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _hashes(phrases: DataFrame) -> DataFrame:
    """``h`` of phrases as the shards have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = (batch.column(k).cast(pa.binary()).to_pylist() for k in (0, 1))
            cols = zip(*[[_word_hash(lang, w) for w in p.split(b" ")] for lang, p in zip(langs, found, strict=True)], strict=True)
            h = [np.array(c, np.uint64) for c in cols]
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(folded(h).view(np.int64))], names=["h"])

    return map_arrow(phrases.select("lang", "phrase"), run, "h long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, n`` of the phrases of 1 to ``longest`` words (4 at most) with ``n >= least``, and ``lang, n`` of all words.

    A phrase is as rare as its rarest word and link, so three passes suffice that each
    count what the one before lets through: words, pairs of frequent words, and longer phrases
    of frequent pairs. What is frequent is known to the tasks as a sieve of bounded size,
    which never stops a frequent phrase; counts decide.
    """
    count = lambda sizes, *bits: phrase_counts(docs, sizes, *bits, text_col=text_col, lang_col=lang_col, shard_words=shard_words)
    words = settle(count((1, 1)), "words")
    often = words.where(F.col("n") >= least)
    found, totals = [often], words.groupBy("lang").agg(F.sum("n").alias("n"))
    if longest >= 2:
        word_bits = sieve(_hashes(often), often.count())
        pairs = settle(count((2, 2), word_bits).where(F.col("n") >= least), "pairs")
        found.append(pairs)
    if longest >= 3:
        pair_bits = sieve(_hashes(pairs), pairs.count())
        found.append(settle(count((3, longest), word_bits, pair_bits).where(F.col("n") >= least), "longer"))
    return reduce(DataFrame.unionByName, found), totals


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases lie within pieces between punctuation marks and line ends. ``a`` counts the phrase,
    ``l`` and ``r`` the two parts of the cut that scores it lowest, ``score`` is
    ``2000000 * a / (l + r)`` without its fraction, ``n`` counts the language's words.
    A phrase inside a longer candidate with four fifths of its occurrences is dropped.

    A null text is empty, a null language is ``und``. Repeated rows count each. An empty
    table gives no rows. Texts of any length are cut into shards. Other columns are not read.
    Parts that many phrases share are looked up between written tables, where Spark can
    split a hot one; a task keeps ``top`` phrases of a language before they are ranked together.
    """
    grams, totals = frequent_phrases(docs, longest, least, text_col, lang_col, shard_words)
    found = grams.where("size >= 2").withColumnRenamed("n", "a")
    w = F.split("phrase", " ", -1)
    join = lambda start, n: F.array_join(F.slice(w, start, n), " ")
    cuts = found.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda name, n: grams.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(18,0)) + cast(r as decimal(18,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spots = F.expr("filter(transform(sequence(0, size * size - 1), i -> struct(cast(floor(i / size) as int) + 1 as start, i % size + 1 as n)), x -> x.n >= 2 and x.n < size and x.start + x.n <= size + 1)")
    inside = found.where("size >= 3").select("lang", "phrase", "a", F.explode(spots).alias("s")).select("lang", join(F.col("s.start"), F.col("s.n")).alias("phrase"), "a")
    held = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80")

    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(evenly(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH pieces AS (
    SELECT lang, [x FOR x IN string_split_regex(p, '[\x20\x09]+') IF x <> ''] AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), grams AS (
    SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM pieces, range(1, 5) t(m)) GROUP BY ALL
), cands AS (
    SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 30
), cuts AS (
    SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM cands) c
    JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 : c.m], ' ')
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(w[s : s + n - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, m - n + 2)) AS s FROM cands, range(2, 4) t(n) WHERE n < m) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM scored LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
