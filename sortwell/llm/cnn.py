"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortwell.llm.arrow import sliced
from sortwell.session import evenly, map_arrow, release, settle, table

#: The bounds of the training sample: rows and words of each label value, taken in the order of a hash of their ids.
ROWS_PER_LABEL, WORDS_PER_LABEL = 2500, 3_000_000
#: A word is the sum of two hashed vectors of its own and one of its first PREFIX letters.
WORD_BUCKETS, PREFIX_BUCKETS, PREFIX, DIM = 1 << 16, 1 << 14, 4, 8
WIDTHS, FILTERS = (1, 2, 3), 6
#: Documents shown in training, half of either label; fewer rows are shown more often.
SHOWN, BATCH, RATE = 18_000, 32, 0.15
#: Share of a document's words that a showing blanks, so that no single rare word settles its label; spread of the first embeddings.
LEAVE_OUT, INIT = 0.5, 0.01
#: Every so many training rows are kept out to set the thresholds.
CALIBRATE = 4
#: The score at which a document counts as toxic; each language's threshold is moved there.
CUT = 0.3
#: Words of a text that are convolved at a time.
SPAN = 1 << 15

#: Frequent function words, by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with as be by this are from at",
    "de": "der die das und in zu den von mit ist nicht ein eine auf für dem im des",
    "fr": "le la les de des et un une en du que qui dans pour sur pas au est",
    "es": "el la los las de del que y en un una por con para se no al es",
}
_LANGS = sorted(FUNCTION_WORDS)
UNKNOWN = len(_LANGS)
#: Letters of the basic plane, and random odd multipliers by character and by place in a word (the places repeat).
_LETTER = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)
_BY_CHAR = np.random.default_rng(11).integers(1, 2**63, 1 << 16, dtype=np.uint64)
_BY_PLACE = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_buckets(text: str) -> np.ndarray:
    """For each run of letters in the lower-cased text two buckets of its hash and one of its prefix's; 0 is padding."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 1 << 16, codes, 0).astype(np.uint16)
    at = np.flatnonzero(_LETTER[codes])
    if not len(at):
        return np.zeros((0, 3), np.int32)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    terms = _BY_CHAR[codes[at]] * _BY_PLACE[place & 63]
    whole = _mixed(np.add.reduceat(terms, first))
    start = _mixed(np.add.reduceat(np.where(place < PREFIX, terms, np.uint64(0)), first))
    ids = np.empty((len(first), 3), np.int32)
    ids[:, 0] = whole & np.uint64(WORD_BUCKETS - 1)
    ids[:, 1] = (whole >> np.uint64(20)) & np.uint64(WORD_BUCKETS - 1)
    ids[:, 2] = start & np.uint64(PREFIX_BUCKETS - 1)
    return np.maximum(ids, 1)


def _language_bits() -> np.ndarray:
    bits = np.zeros(WORD_BUCKETS, np.uint8)
    for k, lang in enumerate(_LANGS):
        for word in FUNCTION_WORDS[lang].split():
            bits[word_buckets(word)[0, 0]] |= 1 << k
    return bits


_BITS = _language_bits()
_HAS = np.arange(1 << len(_LANGS))[:, None] >> np.arange(len(_LANGS)) & 1


def featurise(text: str | None) -> tuple[np.ndarray, int]:
    """Bucket ids of the words, and the number of the language with most function words; UNKNOWN without any."""
    ids = word_buckets(text or "")
    found = np.bincount(_BITS[ids[:, 0]], minlength=1 << len(_LANGS)) @ _HAS
    return ids, int(found.argmax()) if found.any() else UNKNOWN


@dataclass
class Model:
    tables: list[np.ndarray]  # embeddings: two of words, one of prefixes
    kernel: np.ndarray  # DIM x (offsets of all widths) * FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # logits, by language, UNKNOWN last
    scale: float = 1.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.tables[0][ids[:, 0]] + self.tables[1][ids[:, 1]] + self.tables[2][ids[:, 2]]

    def convolve(self, ids: np.ndarray) -> np.ndarray:
        """Activations, one row per window start; windows reach over the end into padding."""
        y = self.embed(ids) @ self.kernel
        parts, at = [], 0
        for width in WIDTHS:
            acc = y[:, at : at + FILTERS].copy()
            for k in range(1, width):
                acc[: len(acc) - k] += y[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            parts.append(acc)
            at += width * FILTERS
        return np.concatenate(parts, axis=1)

    def pool(self, docs: list[np.ndarray]) -> np.ndarray:
        """Max pooled, rectified features of each document."""
        n = len(WIDTHS) * FILTERS
        pooled = np.full((len(docs), n), -np.inf, np.float32)
        pad, group, held = max(WIDTHS) - 1, [], 0

        def flush() -> None:
            nonlocal group, held
            if group:
                pads = np.zeros((pad, 3), np.int32)
                acts = self.convolve(np.concatenate([x for i in group for x in (docs[i], pads)]))
                ends = np.cumsum([len(docs[i]) + pad for i in group])
                for k in range(1, pad + 1):
                    acts[ends - k] = -np.inf
                pooled[group] = np.maximum.reduceat(acts, np.concatenate([[0], ends[:-1]]), axis=0)
            group, held = [], 0

        for i, ids in enumerate(docs):
            if len(ids) > SPAN:
                for at in range(0, len(ids), SPAN):
                    acts = self.convolve(ids[at : at + SPAN + pad])
                    np.maximum(pooled[i], acts[:SPAN].max(axis=0), out=pooled[i])
            elif len(ids):
                if held + len(ids) > SPAN:
                    flush()
                group.append(i)
                held += len(ids)
        flush()
        return np.maximum(pooled + self.bias, 0)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pool(docs) @ self.out + self.out_bias

    def scores(self, docs: list[np.ndarray], langs: np.ndarray) -> np.ndarray:
        z = self.scale * (self.logits(docs) - self.thresholds[langs]) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _winners(m: Model, docs: list[np.ndarray], shown: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The activations that win the pooling, document x filter, and the words of their windows.

    About ``SPAN`` words are convolved at a time, so memory is bounded.
    """
    n, pad = len(WIDTHS) * FILTERS, max(WIDTHS) - 1
    top = np.full((len(docs), n), -np.inf)
    words = np.zeros((len(docs), n, pad + 1, 3), np.int32)
    blank = np.zeros((pad, 3), np.int32)

    def take(group: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Pieces: number of the document, its words and as many of the next ones as a window needs, and which may start one."""
        acts = m.convolve(np.concatenate([x for _, x, _ in group]))
        at = 0
        for d, x, starts in group:
            part = acts[at : at + len(starts)]
            part[~starts] = -np.inf
            best = part.argmax(axis=0)
            value = part[best, np.arange(n)]
            better = value > top[d]
            top[d][better] = value[better]
            words[d][better] = x[best[better][:, None] + np.arange(pad + 1)]
            at += len(x)

    group, held = [], 0
    for d, (ids, s) in enumerate(zip(docs, shown, strict=True)):
        ids = np.concatenate([ids * s[:, None], blank])
        for at in range(0, len(s), SPAN):
            group.append((d, ids[at : at + SPAN + pad], s[at : at + SPAN]))
            held += len(group[-1][1])
            if held >= SPAN:
                take(group)
                group, held = [], 0
    if group:
        take(group)
    return top, words


def gradients(m: Model, docs: list[np.ndarray], y: np.ndarray, shown: list[np.ndarray]) -> tuple[list[np.ndarray], float, list[tuple[np.ndarray, np.ndarray]]]:
    """Of the logistic loss summed over ``docs``: gradients of kernel, bias and out, of the output bias, and (rows, gradients) of each table.

    ``shown`` says which words a showing has; the others are blank like padding, and no
    window starts at one. Only the windows that won the pooling get gradients.
    """
    top, words = _winners(m, docs, shown)
    pooled = top + m.bias
    h = np.where(np.isfinite(pooled), np.maximum(pooled, 0), 0)
    err = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30))) - y
    dh = (err[:, None] * m.out * (h > 0)).astype(np.float32)
    kernel = np.zeros_like(m.kernel)
    rows: list[list[np.ndarray]] = [[], [], []]
    steps, at = [], 0
    for k, width in enumerate(WIDTHS):
        for offset in range(width):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            cols = slice(at + offset * FILTERS, at + (offset + 1) * FILTERS)
            d, f = np.nonzero(dh[:, mine])
            word, g = words[:, mine][d, f, offset], dh[:, mine][d, f]
            np.add.at(kernel.T, cols.start + f, g[:, None] * m.embed(word))
            for t in range(3):
                rows[t].append(word[:, t])
            steps.append(g[:, None] * m.kernel[:, cols].T[f])
        at += width * FILTERS
    step, tables = np.concatenate(steps), []
    for t in range(3):
        where, back = np.unique(np.concatenate(rows[t]), return_inverse=True)
        g = np.zeros((len(where), DIM), np.float32)
        np.add.at(g, back, step)
        g[where == 0] = 0
        tables.append((where, g))
    return [kernel, dh.sum(axis=0), err @ h], float(err.sum()), tables


def fit(docs: list[np.ndarray], langs: np.ndarray, y: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Adagrad on the logistic loss.

    ``prior`` is the share of label 1 in the table, by which the thresholds weigh errors.
    """
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    tables = [rng.normal(0, INIT, (size, DIM)).astype(np.float32) for size in (WORD_BUCKETS, WORD_BUCKETS, PREFIX_BUCKETS)]
    for t in tables:
        t[0] = 0
    m = Model(tables, rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32), np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0, np.zeros(len(_LANGS) + 1, np.float32))
    params = [m.kernel, m.bias, m.out]
    past = [np.full(p.shape, 1e-2, np.float32) for p in (*params, *tables)]
    past_b = 1e-2
    held = np.arange(len(docs)) % CALIBRATE == 0
    train = np.flatnonzero(~held)
    sides = [train[y[train] == k] for k in (0, 1)]
    for _ in range(SHOWN // BATCH):
        batch = np.concatenate([rng.choice(side, BATCH // 2) for side in sides if len(side)])
        shown = [rng.random(len(docs[i])) >= LEAVE_OUT for i in batch]
        dense, dense_b, sparse = gradients(m, [docs[i] for i in batch], y[batch], shown)
        for p, s, g in zip(params, past, dense, strict=False):
            g = g / len(batch)
            s += g * g
            p -= (RATE * g / np.sqrt(s)).astype(np.float32)
        past_b += (dense_b / len(batch)) ** 2
        m.out_bias -= RATE * dense_b / len(batch) / np.sqrt(past_b)
        for table_, s, (where, g) in zip(tables, past[3:], sparse, strict=True):
            g = g / len(batch)
            s[where] += g * g
            table_[where] -= RATE * g / np.sqrt(s[where])
    _calibrate(m, [docs[i] for i in np.flatnonzero(held)], langs[held], y[held], prior)
    return m


def _threshold(z: np.ndarray, y: np.ndarray, prior: float) -> float | None:
    """The middle of the gap between neighbouring logits at which errors, weighed to the table's prior, are fewest."""
    if y.sum() < 5 or (1 - y).sum() < 5:
        return None
    order = np.argsort(z)
    z, y = z[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / y.sum() * prior
    false = (1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()) * (1 - prior)
    at = np.flatnonzero(missed + false <= (missed + false).min() + 1e-12)
    at = at[len(at) // 2]
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    return float((edges[at] + edges[at + 1]) / 2)


def _calibrate(m: Model, docs, langs, y, prior) -> None:
    z = m.logits(docs) if docs else np.zeros(0)
    overall = _threshold(z, y, prior)
    overall = 0.0 if overall is None else overall
    m.thresholds = np.array([t if (t := _threshold(z[langs == k], y[langs == k], prior)) is not None else overall for k in range(len(_LANGS) + 1)], np.float32)


def in_fold(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from a bounded sample of the labelled rows, or None without both values.

    The sample has at most ``ROWS_PER_LABEL`` rows and ``WORDS_PER_LABEL`` words of
    each label value by itself, in the order of a hash of the ids; a row that would
    exceed the words is passed over for the next ones, so only a text of more words than
    the bound itself is never learnt from. The ids of the sample are few by that bound
    and are broadcast; their documents become bucket ids on the executors, where rows
    that repeat an id and its words are made one, and no more than the bound comes to
    the driver. Labels other than 0 and 1, and null ids, are not used; an id with
    several labels or texts counts with each.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    share = known.agg(F.avg("_y")).first()[0]
    if share is None or share in (0.0, 1.0):
        return None
    order = [F.xxhash64(F.lit(7), F.col("_id")), F.col("_id")]
    picked = known.where("_y = 0").orderBy(*order).limit(ROWS_PER_LABEL).union(known.where("_y = 1").orderBy(*order).limit(ROWS_PER_LABEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [featurise(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x, _ in got], pa.int64()), pa.array([x.ravel() for x, _ in got], pa.list_(pa.int32())), pa.array([lang for _, lang in got], pa.int32()), batch.column(2)], names=["id", "words", "ids", "lang", "y"])

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("_id")).select("id", "text", "_y")
    seen = map_arrow(texts, run, f"id {id_type}, words long, ids array<int>, lang int, y int").withColumn("h", F.xxhash64("ids"))
    sample = settle(seen.dropDuplicates(["id", "y", "h"]), "sample")
    fits = []
    for y in (0, 1):
        left = WORDS_PER_LABEL
        for r in sample.where(F.col("y") == y).select("id", "words", "y", "h").orderBy(F.xxhash64(F.lit(7), F.col("id")), "id", "h").limit(ROWS_PER_LABEL).collect():
            if r.words <= left:
                left -= r.words
                fits.append((r.id, r.y, r.h))
    if len({y for _, y, _ in fits}) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame(fits, f"id {id_type}, y int, h long")
    rows = sample.join(F.broadcast(chosen), ["id", "y", "h"]).toArrow().sort_by([("id", "ascending"), ("h", "ascending"), ("y", "ascending")])
    release(sample)
    got = [np.asarray(x.values).reshape(-1, 3) for x in rows["ids"]]
    y = rows["y"].to_numpy().astype(np.float32)
    mixed = np.random.default_rng(3).permutation(len(y))
    return fit([got[i] for i in mixed], rows["lang"].to_numpy()[mixed], y[mixed], float(share))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and ``out_col`` from 0 to 1.

    The whole text is convolved, long ones by spans that overlap. Null and empty
    texts, and those without letters, get the score of no evidence. Without a model
    (labels of one value only) scores are 0. No other column is an input; the language
    is guessed from the text, and a text without a known function word has a threshold
    of its own. Rows are independent, repeated ones score alike, and none is dropped.
    Columns keep their names inside ``row``, so none can clash.
    """
    kept = docs.select(F.struct("*").alias("row"))
    if model is None:
        return kept.withColumn(out_col, F.lit(0.0))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            inner = batch.column(0)
            flat = pa.RecordBatch.from_arrays([inner, inner.field(text_col)], names=["row", "text"])
            for part in sliced(iter([flat])):
                got = [featurise(t.as_py()) for t in part.column(1)]
                s = m.scores([x for x, _ in got], np.array([lang for _, lang in got], int))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["row", out_col])

    return map_arrow(kept, run, T.StructType([kept.schema["row"], T.StructField(out_col, T.DoubleType())]))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, score, predicted`` for every document, trained outside the held-out fold."""
    model = train(docs, labels.where(~in_fold("doc_id", 4, 2)))
    return score(docs, model).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(spark, evenly(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "score", "predicted").select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")
