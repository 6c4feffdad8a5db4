"""Runs of equal keys in Arrow batches whose rows come sorted by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _codes(col: pa.Array) -> list[np.ndarray]:
    """Numbers that are equal where the values are, nulls included."""
    if pa.types.is_struct(col.type):
        return [col.is_valid().to_numpy(zero_copy_only=False), *(c for f in col.flatten() for c in _codes(f))]
    return [col.dictionary_encode(null_encoding="encode").indices.to_numpy()]


def starts(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row begins a run of equal ``keys``; ``last`` ends with the row before the batch."""
    out = np.zeros(batch.num_rows, bool)
    if not batch.num_rows:
        return out
    for k in keys:
        for c in _codes(batch.column(batch.schema.get_field_index(k))):
            out[1:] |= c[1:] != c[:-1]
    value = lambda b, r: [b.column(b.schema.get_field_index(k))[r].as_py() for k in keys]
    out[0] = last is None or value(last, last.num_rows - 1) != value(batch, 0)
    return out


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal ``keys`` as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [*np.flatnonzero(starts(batch, keys, last)).tolist(), batch.num_rows]
        if at[0] > 0:
            held.append(batch.slice(0, at[0]))
        for a, b in zip(at, at[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = batch
    if held:
        yield pa.Table.from_batches(held)


def groups_within(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a batch with equal ``keys`` as a table, in whatever order they come."""
    if batch.num_rows:
        codes = [c for k in keys for c in _codes(batch.column(batch.schema.get_field_index(k)))]
        yield from by_group(iter([batch.take(pa.array(np.lexsort(codes)))]), keys)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches none of which ends within a run of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(starts(batch, keys, last))
        if len(begins) and (held or begins[-1]):
            yield from joined([*held, batch.slice(0, begins[-1])])
            held = [batch.slice(begins[-1])]
        else:
            held.append(batch)
        last = batch
    if held:
        yield from joined(held)
