"""Quality: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.llm.arrow import sliced
from sortwell.llm.cnn import in_fold
from sortwell.session import evenly, map_arrow, settle, table

#: Shares of the pooled covariance and of its diagonal in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
#: The score from which a document is predicted to be good; even odds are moved there.
CUT = 0.3
#: Share of the log density difference that goes into a score: statistics are correlated, so whole differences are too sure.
SCALE = 0.5
#: Words of a text whose pairs are taken at a time; distinct ones are held as 16-byte digests in a longer text.
SPAN = 1 << 16

#: Shares are taken as if a text had so many more bytes or words with ordinary shares, so short texts are not extreme.
MORE_BYTES, MORE_WORDS = 120, 24

STATISTICS = ("word_length", "marks", "pipes", "capitals", "bangs", "digits", "stops", "commas", "distinct_words", "distinct_pairs", "distinct_lines", "short_words", "other_bytes")

_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#$%&*@~^_=+<>{}[]\\`", b"|", bytes(range(65, 91)), b"!?", b"0123456789", b".", b",;:", bytes(range(128, 256)), b" \t\n\r\x0b\x0c"), start=1):
    _KIND[list(_chars)] = _k


def distinct_pairs(words: list[bytes]) -> int:
    """The number of different pairs of neighbouring words in the whole list."""
    if len(words) <= SPAN:
        return len(set(zip(words, words[1:], strict=False)))
    seen: set[bytes] = set()
    for i in range(0, len(words), SPAN):
        part = set(zip(words[i : i + SPAN], words[i + 1 : i + 1 + SPAN], strict=False))
        seen.update(xxhash.xxh3_128_digest(b" ".join(p)) for p in part)
    return len(seen)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text, in the order of STATISTICS; shares are logs over a floor."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), len(data)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=10)
    shown = max(1, size - kinds[9])
    in_bytes = lambda k, usual: np.log((k + MORE_BYTES * usual) / (shown + MORE_BYTES) + 1e-3)
    in_words = lambda k, usual: np.log((k + MORE_WORDS * usual) / (n + MORE_WORDS) + 1e-3)
    at_most = lambda distinct, of: np.log((distinct + MORE_WORDS) / (of + MORE_WORDS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return np.array(
        [
            in_words(shown, 5.0),
            in_bytes(kinds[1], 0.0),
            in_words(kinds[2], 0.0),
            in_bytes(kinds[3], 0.03),
            in_words(kinds[4], 0.0),
            in_bytes(kinds[5], 0.0),
            in_words(kinds[6], 0.1),
            in_words(kinds[7], 0.07),
            at_most(len(set(words)), n),
            at_most(distinct_pairs(words), max(0, n - 1)),
            at_most(len(set(lines)), len(lines)),
            in_words(sum(len(w) <= 3 for w in words), 0.3),
            in_bytes(kinds[8], 0.02),
        ]
    )


@dataclass
class Discriminant:
    """Class means and the Cholesky factors of the shrunk class covariances, held once for all scores."""

    means: np.ndarray  # 2 x d
    factors: np.ndarray  # 2 x d x d, lower triangular
    log_norm: np.ndarray  # log prior - half log determinant, by class
    scale: float
    shift: float

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        out = []
        for mean, factor, norm in zip(self.means, self.factors, self.log_norm, strict=True):
            z = (x - mean).T
            for i in range(len(z)):  # forward substitution in the triangular factor
                z[i] = (z[i] - factor[i, :i] @ z[:i]) / factor[i, i]
            out.append(norm - 0.5 * (z * z).sum(axis=0))
        return out[1] - out[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1 by the scaled and moved log ratio. Even odds score ``CUT``; a score is an order, not a probability."""
        z = self.scale * self.log_ratio(x) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def discriminant(n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
    """From the classes' counts, sums and sums of outer products."""
    means = sums / n[:, None]
    covs = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (n[:, None, None] * covs).sum(axis=0) / n.sum()
    own = (1 - TO_POOLED) * covs + TO_POOLED * pooled
    eye = np.eye(len(pooled))
    own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * eye * np.diagonal(pooled) + 1e-6 * eye
    factors = np.linalg.cholesky(own)
    log_norm = np.log(n / n.sum()) - np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, factors, log_norm, SCALE, float(np.log(CUT / (1 - CUT))))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x`` of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {id_type}, x array<double>")


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | float:
    """Class moments over all labelled rows, added up on the executors.

    Without two rows of both values there is no model but the share of label 1 among
    the labelled rows (0 without any). A null id is not labelled.
    """
    d = len(STATISTICS)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = stats.join(known, "id")
    cells = F.array(*[F.col("x")[i] * F.col("x")[j] for i in range(d) for j in range(i, d)])
    terms = F.concat(F.array(F.lit(1.0)), F.col("x"), cells)
    width = 1 + d + d * (d + 1) // 2
    sums = rows.select("y", terms.alias("t")).groupBy("y").agg(*[F.sum(F.col("t")[k]).alias(f"s{k}") for k in range(width)]).collect()
    got = {r.y: np.array(r[1:], float) for r in sums}
    if set(got) != {0, 1} or min(v[0] for v in got.values()) < 2:
        n = {k: v[0] for k, v in got.items()}
        return float(n.get(1, 0.0) / sum(n.values())) if n else 0.0
    m = np.stack([got[0], got[1]])
    squares = np.zeros((2, d, d))
    i, j = np.triu_indices(d)
    squares[:, i, j] = squares[:, j, i] = m[:, 1 + d :]
    return discriminant(m[:, 0], m[:, 1 : 1 + d], squares)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, score`` from 0 to 1, higher where label 1 is likelier.

    Statistics cover whole texts; null and empty texts have those of zero words.
    Without a usable model all rows score the share of label 1 (see ``train``).
    Repeated rows and ties score alike, and several labels of an id all count. A null
    id is scored like others. Other columns are not read, so none can clash; an empty
    table gives no rows. Texts are read once; statistics are
    written to the shared folder and serve training and scoring, so the join with
    the labels moves no text.
    """
    stats = settle(document_statistics(docs, id_col, text_col), "statistics")
    model = train(stats, labels, id_col)
    if isinstance(model, float):
        return stats.select(F.col("id").alias(id_col), F.lit(model).alias("score"))
    id_type = stats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["id", "score"])

    return map_arrow(stats, run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 5, 0))
    scored = quality(evenly(table(spark, sf_dir, "documents")), labels)
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
