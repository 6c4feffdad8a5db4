"""Small pieces that Arrow-based operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that a task handles at a time; a longer text is handled alone.
SLICE_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE_BYTES`` of text, so memory stays bounded."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start = held = 0
        for i, n in enumerate(pc.binary_length(col).fill_null(0).to_pylist()):
            if held and held + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def spans(data: bytes, cut: re.Pattern[bytes], size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, each ending after a match of ``cut``; together they are the whole."""
    start = 0
    while len(data) - start > size and (found := cut.search(data, start + size)):
        yield data[start : found.end()]
        start = found.end()
    yield data[start:]
