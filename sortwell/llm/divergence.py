"""Source divergence audit: how far the term shares of a source lie from those of others and of its language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortwell.llm.arrow import sliced, spans
from sortwell.session import evenly, map_arrow, settle, table

#: Documents of a language that a kept term is in at least, and terms of a group in the report.
LEAST_DOCS, TOP = 3, 200
#: What shares are scaled to.
SCALE = 1_000_000_000
#: Distinct (group, term) counts that a task holds before it gives them out, and node-ancestor combinations at a time.
HELD, AT_ONCE = 400_000, 1 << 20
#: Groups that are broadcast, counted before (about 100 bytes each); beyond, Spark joins as it sees fit.
LOOKUP_ROWS = 100_000

#: Bytes of terms are letters and those of other characters than ASCII.
_TERMS = bytes(b if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` in parts: occurrences, and documents that hold the term. Whole texts, in spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        in_docs: dict[tuple, Counter] = {}
        held = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                terms, of = list(found), in_docs[lang, source]
                for at in range(0, len(terms), 1 << 16):
                    some = terms[at : at + (1 << 16)]
                    cols = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([found[t] for t in some], pa.int64()), pa.array([of[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            in_docs.clear()

        for batch in sliced(batches):
            for lang, source, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).cast(pa.binary()), strict=True):
                seen: set[bytes] = set()
                group = counts.setdefault((lang, source), Counter())
                before = len(group)
                for span in spans(value.as_py() or b"", _GAP):
                    terms = span.lower().translate(_TERMS).split()
                    group.update(terms)
                    seen.update(terms)
                in_docs.setdefault((lang, source), Counter()).update(seen)
                held += len(group) - before
                if held >= HELD:
                    yield from given()
                    held = 0
        yield from given()

    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return map_arrow(docs.select("text", word("lang"), word("source")), run, "lang string, source string, term string, n long, docs long")


def _share(n: str, total: str) -> str:
    """``1 + floor(SCALE * (n + 1) / total)`` in whole numbers; null for a total of 0."""
    return f"1 + (cast({SCALE} as decimal(12,0)) * (cast({n} as decimal(18,0)) + 1)) div cast(nullif({total}, 0) as decimal(20,0))"


def _gap(p: str, q: str) -> str:
    """``floor((p - q)^2 / q)``; shares are at most ``SCALE + 1``, so squares fit."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tree_nodes(group: np.ndarray, n: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the prefix tree of sorted rows: ``cell, depth, times``.

    Rows are runs of cells (group, n), ``lengths`` long, each there ``times`` times. A node is
    named by its first cell and stands for the rows that share the path to it.
    """
    start = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(group)) - start[row]
    above = np.where((row > 0) & (depth < lengths[row - 1]), start[row - 1] + depth, -1)
    differs = (above < 0) | (group != group[above]) | (n != n[above])
    shared = np.minimum.reduceat(np.where(differs, depth, lengths[row]), start) if len(lengths) else lengths
    new = depth >= shared[row]
    order = np.lexsort((row, depth))
    heads = np.flatnonzero(new[order])
    return order[heads], depth[order[heads]], np.add.reduceat(times[row[order]], heads) if len(heads) else times[:0]


def pair_corrections(paths: DataFrame) -> DataFrame:
    """``lang, source, item, high, low`` from ``lang, path, times``: what terms of two sources add to the sums of each by itself, in parts.

    Term rows come sorted, so their tree is read off neighbours, a batch at a time; a
    node's corrections with its ancestors are computed once, times its rows. A value
    is ``high * 2^31 + low``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(1)
            lengths = np.diff(path.offsets.to_numpy()).astype(np.int64)
            flat = path.flatten()
            p0, n, p = (flat.field(k).to_numpy() for k in ("p0", "n", "p"))
            langs = batch.column(0).dictionary_encode()
            sources = flat.field("source").dictionary_encode()
            many = max(1, len(sources.dictionary))
            group = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths) * many + sources.indices.to_numpy()
            times = batch.column(2).to_numpy()
            cell, depth, rows = tree_nodes(group, n, lengths, times)
            cuts = np.searchsorted(np.cumsum(depth), np.arange(0, int(depth.sum()), AT_ONCE), "right") if len(depth) else []
            for a, b in zip(cuts, [*cuts[1:], len(depth)], strict=True):
                d = depth[a:b]
                low = np.repeat(cell[a:b], d)
                high = low - np.repeat(d, d) + np.arange(len(low)) - np.repeat(np.cumsum(d) - d, d)  # from the root down
                both = np.concatenate([group[high] * (group.max() + 1) + group[low], group[low] * (group.max() + 1) + group[high]])
                value = np.concatenate([_gaps(p[x], p[y]) - _gaps(p[x], p0[y]) - _gaps(p0[x], p[y]) + _gaps(p0[x], p0[y]) for x, y in ((high, low), (low, high))])
                weight = np.tile(np.repeat(rows[a:b], d), 2)
                order = np.argsort(both, kind="stable")
                if not len(order):
                    continue
                both, value, weight = both[order], value[order], weight[order]
                first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                of, item = both[first] // (group.max() + 1), both[first] % (group.max() + 1)
                name = lambda g: sources.dictionary.take(pa.array(g % many))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(of // many)), name(of), name(item),
                    pa.array(np.add.reduceat((value >> 31) * weight, first)), pa.array(np.add.reduceat((value & ((1 << 31) - 1)) * weight, first)),
                ], names=["lang", "source", "item", "high", "low"])

    return map_arrow(paths.select("lang", "path", "times"), run, "lang string, source string, item string, high long, low long")


def divergence(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of each group of documents with a language and a source.

    A language keeps the terms in at least ``least_docs`` of its documents. A share
    is that of a term in a group's or the language's words, one added to each count, in
    parts of ``SCALE``. Part ``pair``: the squared distances from each other source of
    the language, relative to its shares and summed over all kept terms. Part ``term``: the
    ``top`` terms that the group uses more than its language.

    A pair's sum is that of two groups without terms, plus what the terms of each
    change by themselves (by histograms of counts), plus a correction for terms of
    both, from a tree of the terms' rows of counts (see ``pair_corrections``). All
    numbers are whole; sums are decimals.

    Null text, language and source are empty strings; a group without terms is one like others,
    and a language without kept terms has pairs of value 0. Repeated rows count
    each. An empty table gives no rows; other columns are not read. Texts are counted
    where they are; of a frequent term one row per source and count table is shuffled.
    """
    by_source = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = by_source.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "head": F.min("source").over(of_term) == F.col("source")})
    cells = settle(counted.where(F.col("lang_docs") >= least_docs).select("lang", "term", "source", "n", "lang_n", "head"), "cells")

    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    langs = cells.groupBy("lang").agg(F.count_if("head").alias("v"), F.sum("n").alias("lang_total"))
    used = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(word("lang"), word("source")).distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = settle(groups.select("lang", "source", "v", (F.col("total") + F.col("v")).alias("total"), (F.col("lang_total") + F.col("v")).alias("lang_total")).withColumn("p0", F.expr(_share("0", "total"))), "groups")
    look = F.broadcast if groups.count() <= LOOKUP_ROWS else (lambda side: side)

    shares = cells.join(look(groups), ["lang", "source"]).withColumn("p", F.expr(_share("n", "total")))
    of_group = Window.partitionBy("lang", "source")
    terms = shares.withColumn("q", F.expr(_share("lang_n", "lang_total"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(of_group.orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)

    path = F.array_sort(F.collect_list(F.struct("p0", "source", "n", "p")))
    paths = settle(shares.groupBy("lang", "term").agg(path.alias("path")).where("size(path) > 1").groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")), "paths")
    both = pair_corrections(paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")).groupBy("lang", "source", "item").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    # each source, as the first and as the second of a pair
    counts = settle(shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("times")), "counts")
    other = look(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0")))
    alone = counts.join(other, "lang").where("source <> other")
    number = lambda sql: F.expr(f"cast({sql} as decimal(38,0))")
    times = lambda n, gap, less: number(f"cast({n} as decimal(19,0)) * cast(({gap}) - ({less}) as decimal(19,0))").alias("value")
    parts = [
        groups.join(other, "lang").where("source <> other").select("lang", "source", F.col("other").alias("item"), number(f"cast(v as decimal(19,0)) * cast({_gap('p0', 'other_p0')} as decimal(19,0))").alias("value")),
        alone.select("lang", "source", F.col("other").alias("item"), times("times", _gap("p", "other_p0"), _gap("p0", "other_p0"))),
        alone.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), times("times", _gap("other_p0", "p"), _gap("other_p0", "p0"))),
        both.select("lang", "source", "item", number(f"cast(high as decimal(19,0)) * cast({1 << 31} as decimal(10,0)) + cast(low as decimal(19,0))").alias("value")),
    ]
    summed = parts[0]
    for more in parts[1:]:
        summed = summed.unionByName(more)
    pairs = summed.groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(of_group.orderBy(F.col("value").desc(), "item")))
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(evenly(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (
    SELECT r, lang, source, unnest(w) AS term FROM texts
), kept AS (
    SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), langs AS (
    SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total, coalesce(lang_total, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
), grid AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
           1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (g.lang_total + g.v) AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM grid WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
