"""Mixing sources to target weights: capped water-filling and seeded repetitions (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortwell.operators.index import with_position
from sortwell.session import settle, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
#: Slices of the hash range in which a source's words are summed before its cut is sought in one of them.
SLICES = 1024
#: Sources up to this number are broadcast (about 100 bytes each); more are joined by a shuffle, a source spread over SPREAD sub-keys.
FEW_SOURCES, SPREAD = 100_000, 32

WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: str):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def place(id_col: str, text_col: str, seed: int):
    """A document's place in its source's seeded order: 60 bits of the MD5 of seed, id and text, so only rows that repeat both share one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _slice_of(u):
    return F.shiftright(u, 60 - SLICES.bit_length() + 1).cast("int")


def _with_plan(rows: DataFrame, plan: DataFrame, n_sources: int, on: str = "source", spread: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``plan`` (``_s`` is its source).

    A plan of many sources is repeated for the sub-keys to which rows are dealt by a
    hash of ``spread``, so a hot source is many tasks' work also when it is joined by
    a shuffle.
    """
    match = F.col(on).eqNullSafe(F.col("_s"))
    if n_sources <= FEW_SOURCES:
        return rows.join(F.broadcast(plan), match).drop("_s")
    if spread is None:
        return rows.join(plan, match).drop("_s")
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(F.col(spread)), F.lit(SPREAD)).cast("int"))
    side = plan.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(side, match & (F.col("_way") == F.col("_at"))).drop("_s", "_way", "_at")


def water_fill(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights are dealt to the sources in code-point order (null last), repeating.
    The budget is ``share`` of all sizes. A source takes ``level * weight`` up to
    ``max_epochs * size``. Each round clamps the sources whose share is above their
    cap and deals the rest of the budget to the others by weight, until none is
    above: one sum over a row per source. A round at least halves what is dealt too
    much or the weight that is left to share it, so rounds grow with the logarithm of
    the budget (about 40 at 10^14 words, in practice a few). Sources are numbered by
    ranges, so none of this puts all of them into one task.

    Sources without words have the target 0. An empty table gives no rows.
    """
    numbered = with_position(sources.select("source", "source_size", F.lit(0).alias("all")), "all", [F.col("source").asc_nulls_last()], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    caps = settle(numbered.select("source", "source_size", w.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap")), "caps")
    budget = float(share) * float(caps.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        above = F.col("cap") / F.col("weight") < level
        dealt = caps.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if dealt[1] is None:  # all are clamped
            return caps.select("source", "source_size", F.col("cap").alias("target"))
        following = (budget - (dealt[0] or 0.0)) / dealt[1]
        if following <= level:
            return caps.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))
        level = following


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **shares) -> tuple[DataFrame, DataFrame]:
    """``(rows, plan)``: sizes and order hashes of the documents, and one row per source.

    A source's target is ``epochs`` whole repetitions of all its documents and a
    fraction. For the fraction its documents follow a seeded hash: those before the
    hash ``cut`` are taken once more in full, and the one at the cut gives the words
    still missing (``part``); of several equal rows there (``tied``) the first ones give
    all their words. The cut is sought in sums over slices of the hash range and then
    within one slice, so no source is ordered as a whole.
    """
    rows = settle(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), place(id_col, text_col, seed).alias("u")),
        "sizes",
    )
    rows = rows.withColumn("slice", _slice_of("u"))
    sums = settle(rows.groupBy("source", "slice").agg(F.sum("size").alias("size")), "slices")
    sources = water_fill(sums.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), **shares)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    dealt = sources.withColumn("epochs", epochs.cast("long")).withColumn("missing", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # rounded up to all words, the fraction is a whole repetition and has no cut
    full = (F.col("source_size") > 0) & (F.col("missing") >= F.col("source_size"))
    plan = settle(
        dealt.withColumn("epochs", F.col("epochs") + full.cast("long")).withColumn("missing", F.when(full, F.lit(0)).otherwise(F.col("missing")).cast("long")),
        "targets",
    )
    n_sources = plan.count()
    side = lambda df, *cols: df.select(F.col("source").alias("_s"), *cols)
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_of_cut = (
        _with_plan(sums, side(plan, "missing"), n_sources)
        .where("missing > 0")
        .withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0)))
        .where((F.col("before") <= F.col("missing")) & (F.col("missing") < F.col("before") + F.col("size")))
        .select("source", F.col("slice").alias("cut_slice"), (F.col("missing") - F.col("before")).alias("need"))
    )
    inside = _with_plan(rows, side(slice_of_cut, "cut_slice", "need"), n_sources, spread="u").where("slice = cut_slice").groupBy("source", "u", "need").agg(F.sum("size").alias("at_cut"), F.count(F.lit(1)).alias("tied"))
    along_u = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        inside.withColumn("before", F.coalesce(F.sum("at_cut").over(along_u), F.lit(0)))
        .where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("at_cut")))
        .select(F.col("source").alias("_c"), F.col("u").alias("cut"), "tied", (F.col("need") - F.col("before")).alias("part"))
    )
    return rows, settle(plan.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c"), "plan")


def _extra(rows: DataFrame) -> DataFrame:
    """``rows`` with ``extra``, the words of one more, partial take, from ``source, u, size, cut, part, tied``.

    Rows at a cut of their source give its part. Of equal rows there each is told by its
    number among them, which ranges of rows have to be sorted for; there are few of
    them unless rows repeat.
    """
    at_cut = F.coalesce(F.col("u") == F.col("cut"), F.lit(False))
    single = rows.where(~at_cut | (F.col("tied") == 1)).withColumn("extra", F.when(at_cut, F.col("part")).otherwise(F.lit(0)).cast("long"))
    tied = rows.where(at_cut & (F.col("tied") > 1))
    if tied.isEmpty():
        return single
    dealt = with_position(settle(tied, "tied"), "source", [F.col("u")], "nth")
    extra = F.greatest(F.lit(0), F.least("size", F.col("part") - F.col("nth") * F.col("size")))
    return single.unionByName(dealt.withColumn("extra", extra.cast("long")).drop("nth"))


def repetitions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``times`` (whole takes) and ``extra`` (words of one more, partial take)."""
    joined = _with_plan(rows, plan.withColumn("_s", F.col("source")).drop("source"), plan.count(), spread="u")
    # a source of which no fraction is missing has no cut
    once_more = F.coalesce(F.col("u") < F.col("cut"), F.lit(False))
    return _extra(joined).withColumn("times", F.col("epochs") + once_more.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, times, extra.

    ``taken`` is ``times * size + extra``: whole repetitions, and for the document at
    its source's cut a part of one more. A source's ``taken`` sum to its target
    rounded to a word, also where ids are null or repeat. A null source is a source;
    null and empty texts have size 0 and are taken with 0 words. An empty table gives
    no rows; other columns are not read. The result depends only on ids, texts,
    sources and the seed, not on partitioning; which of several equal rows gives the words at
    a cut is not told apart by it.
    """
    rows, plan = mix_plan(docs, id_col, text_col, source_col, **options)
    out = repetitions(rows, plan)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("extra")).alias("taken"), "times", "extra")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str = "n_chars", **options) -> DataFrame:
    """The mixed rows themselves: each document as often as it is taken.

    A part is the document up to the end of its last word taken, with its length in
    ``n_chars_col`` put right. Columns of ``docs`` are kept, whatever their names.
    Decisions come from a lookup of the source's plan and the id's hash; texts are
    shuffled only above ``FEW_SOURCES`` sources.

    Null and empty texts are taken like other documents of their source, never more
    often than the epochs allow, and stay null or empty. A null source is a source;
    rows that repeat are taken each. An empty table gives no rows.
    """
    seed = options.get("seed", SEED)
    _, plan = mix_plan(docs, id_col, text_col, source_col, **options)
    side = plan.select(F.col("source").alias("_s"), "epochs", "cut", "tied", "part")
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), n_words(text_col).alias("size"), place(id_col, text_col, seed).alias("u"))
    times = (F.col("epochs") + F.when(F.col("u") < F.col("cut"), 1).otherwise(0)).cast("int")
    # a word with the white space before it is one piece
    pieces = F.split("text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    picked = (
        _extra(_with_plan(rows, side, plan.count(), spread="u"))
        .withColumn("words", F.col("extra").cast("int"))
        .withColumn("whole", F.explode(F.concat(F.array_repeat(F.lit(True), times), F.array_repeat(F.lit(False), (F.col("words") > 0).cast("int")))))
        .withColumn("text", F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, F.col("words")), "")))
    )
    out = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("text")}
    if n_chars_col in out:
        out[n_chars_col] = F.when(F.col("whole"), out[n_chars_col]).otherwise(F.length("text").cast(docs.schema[n_chars_col].dataType))
    return picked.select(*[c.alias(n) for n, c in out.items()])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("times", "extra")


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
fit AS (SELECT min_by(level, r) AS level FROM levels WHERE level <= cap / weight),
targets AS (
  SELECT source, source_size, CASE WHEN fit.level IS NULL THEN cap ELSE least(cap, fit.level * weight) END AS target
  FROM levels CROSS JOIN fit),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         round(target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size)::BIGINT AS missing
  FROM targets),
laid AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.missing, d.u,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(d.size) OVER (PARTITION BY d.source, d.u) AS here,
         row_number() OVER (PARTITION BY d.source, d.u) - 1 AS nth
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN before + here <= missing AND here > 0 THEN size
                             WHEN before <= missing AND here > 0 THEN greatest(0, least(size, missing - before - nth * size))
                             ELSE 0 END)::BIGINT AS taken
FROM laid
"""
