"""Vectors, hashes and their distances as column expressions; token vectors by Arrow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sortwell.session import map_arrow

BUCKETS = 64
#: UTF-8 bytes of text that a task splits at a time; a longer text is split alone.
SLICE_BYTES = 8 << 20


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda in the body uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def file_hash(content: Column) -> Column:
    """MD5 in hex; null content has none."""
    return F.md5(content)


def with_token_vector(docs: DataFrame, text: str = "text", name: str = "v") -> DataFrame:
    """``docs`` with ``name`` for ``text``: counts of the tokens between spaces in 64 buckets, by the first byte of a token's MD5.

    Arrow splits the texts, and each different token of a slice is hashed once. No row is exploded
    and nothing is shuffled. A null text has a null vector; an empty one has one token, which is empty.
    """
    others = [f for f in docs.schema if f.name != text]
    schema = StructType([*others, StructField(name, ArrayType(DoubleType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = batch.slice(a, b - a)
                tokens = pc.split_pattern(rows[text], " ")
                coded = tokens.flatten().dictionary_encode()
                different = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
                bucket = np.fromiter((hashlib.md5(t, usedforsecurity=False).digest()[0] % BUCKETS for t in different), np.int64, len(different))
                row = np.repeat(np.arange(len(rows)), pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))
                counts = np.bincount(row * BUCKETS + bucket[coded.indices.to_numpy()], minlength=len(rows) * BUCKETS).astype(np.float64)
                v = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * BUCKETS).astype(np.int32)), pa.array(counts), mask=rows[text].is_null())
                yield pa.RecordBatch.from_arrays([*(rows[f.name] for f in others), v], names=[f.name for f in schema])

    return map_arrow(docs, count, schema)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column, extra: float = 0.0) -> Column:
    """``v`` over its length; a zero vector stays zero."""
    return bound(norm(v) + extra, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def share_of_sum(v: Column) -> Column:
    """A histogram's shares, as of its sum plus 1e-7."""
    return bound(total(v) + F.lit(1e-7), lambda n: F.transform(v, lambda x: x / n))


def entropy(shares: Column) -> Column:
    """Shannon entropy in nats with 1e-10 added under the logarithm."""
    return -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log(p + F.lit(1e-10)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = norm(F.transform(a, lambda x: x.cast("double"))) * norm(F.transform(b, lambda x: x.cast("double")))
    return F.coalesce(F.try_divide(dot, length), F.lit(0.0))


def average_hash(v: Column) -> Column:
    """A string of bits: 1 where a component is over the mean."""
    return bound(total(v) / F.size(v), lambda mean: F.array_join(F.transform(v, lambda x: F.when(x > mean, "1").otherwise("0")), ""))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings differ; of different lengths, the first one's length."""
    at = F.sequence(F.lit(1), F.length(a))
    differ = F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.when(F.length(a) != F.length(b), F.length(a)).when(F.length(a) == 0, 0).otherwise(differ)


def rotations(bits: Column, side: int = 8) -> Column:
    """The four strings of ``bits``, a square of ``side`` rows, turned by quarters; the first is itself."""
    places = F.lit([side * (side - 1 - k % side) + k // side + 1 for k in range(side * side)])
    quarter = F.array_join(F.transform(places, lambda i: F.substring(bits, i, 1)), "")
    return F.array(bits, quarter, F.reverse(bits), F.reverse(quarter))  # turned by half, a string is read backwards


def canonical_rotation(bits: Column, side: int = 8) -> Column:
    """The least of the four rotations, so turned copies have one key and meet by equality; null for other lengths."""
    return F.when(F.length(bits) == side * side, F.array_min(rotations(bits, side)))
