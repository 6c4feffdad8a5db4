"""A bidirectional FM-index over the word ids of a shard, for patterns of a few words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Words of a pattern at most. Suffixes are ordered by so many symbols only.
DEPTH = 4


class Half(NamedTuple):
    """The index in one direction: the symbol before each suffix in order, and its occurrences by (symbol, place)."""

    bwt: np.ndarray
    occurrences: np.ndarray


class Index(NamedTuple):
    ahead: Half
    back: Half
    n_symbols: int


class Intervals(NamedTuple):
    """Patterns of one length: their words by column, where their suffixes begin in both directions, and how many there are."""

    words: np.ndarray
    ahead: np.ndarray
    back: np.ndarray
    size: np.ndarray


def _half(ids: np.ndarray, n_symbols: int) -> Half:
    n = len(ids)
    rank, step = ids.astype(np.int64), 1
    while step < DEPTH:  # ranks by 1, 2, 4 symbols
        after = np.append(rank[step:], np.zeros(step, np.int64))
        keys, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        step *= 2
    order = np.argsort(rank, kind="stable")
    bwt = ids[order - 1].astype(np.int64)  # cyclic; the ends are separators
    return Half(bwt, np.sort(bwt * (n + 1) + np.arange(n)))


def build(ids: np.ndarray, n_symbols: int) -> Index:
    """The index of ``ids`` below ``n_symbols``; 0 is a separator, which no pattern holds, and has to be first and last."""
    return Index(_half(ids, n_symbols), _half(ids[::-1], n_symbols), n_symbols)


def words(ids: np.ndarray, n_symbols: int) -> Intervals:
    """All patterns of one word: what stands before a symbol in the order of the suffixes."""
    counts = np.bincount(ids, minlength=n_symbols)
    first = np.cumsum(counts) - counts
    found = np.flatnonzero(counts)
    found = found[found > 0]
    return Intervals(found[:, None], first[found], first[found], counts[found])


def _step(half: Half, n_symbols: int, lo: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """All extensions by one symbol in the direction of ``half``: ``owner, symbol, lo, other, size``.

    The symbols in front of an interval's suffixes, each with its number, are its extensions.
    Their place in this direction follows from the occurrences before the interval; in
    the other direction they follow each other within the interval.
    """
    n = len(half.bwt)
    owner = np.repeat(np.arange(len(lo)), size)
    cells = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
    both, counts = np.unique(owner * n_symbols + half.bwt[cells], return_counts=True)
    owner, symbol = both // n_symbols, both % n_symbols
    before = np.cumsum(counts) - counts
    before -= (np.cumsum(size) - size)[owner]
    real = symbol > 0
    owner, symbol, counts, before = owner[real], symbol[real], counts[real], before[real]
    return owner, symbol, np.searchsorted(half.occurrences, symbol * (n + 1) + lo[owner]), other[owner] + before, counts


def to_left(index: Index, found: Intervals) -> Intervals:
    """All patterns with a word more in front."""
    owner, symbol, ahead, back, size = _step(index.ahead, index.n_symbols, found.ahead, found.back, found.size)
    return Intervals(np.column_stack([symbol, found.words[owner]]), ahead, back, size)


def to_right(index: Index, found: Intervals) -> Intervals:
    """All patterns with a word more behind."""
    owner, symbol, back, ahead, size = _step(index.back, index.n_symbols, found.back, found.ahead, found.size)
    return Intervals(np.column_stack([found.words[owner], symbol]), ahead, back, size)


def patterns(ids: np.ndarray, n_symbols: int, longest: int) -> Iterator[Intervals]:
    """All patterns of 1 to ``longest`` words of ``ids`` with their counts, extended left and right in turn."""
    found = words(ids, n_symbols)
    yield found
    index = build(ids, n_symbols) if longest > 1 else None
    for size in range(2, longest + 1):
        found = to_right(index, found) if size % 2 else to_left(index, found)
        yield found
