"""A bounded sieve over hashes: it lets all members through and a share of the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and bits at most: 8 MB. With more hashes more strangers pass, never fewer members.
BITS_EACH, MOST_BITS = 64, 1 << 26


def sieve(hashes: DataFrame, count: int, most: int = MOST_BITS) -> np.ndarray:
    """The bits of the column ``h`` of ``hashes``; null hashes have none.

    It is put together by the executors; the driver receives at most ``most / 64``
    words of it, whatever the number of hashes. A sieve never answers by itself: what
    passes is joined with the real rows.
    """
    bits = 64
    while bits < min(most, count * BITS_EACH):
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = hashes.where("h IS NOT NULL").select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of an array of uint64 hashes, which may be members."""
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of word hashes; a run of words hashes alike wherever its words come from."""
    out = columns[0].copy()
    for more in columns[1:]:
        out *= np.uint64(0x100000001B3)
        out += more
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes, by its first place."""
    n = max(0, len(words) - size + 1)
    return folded([words[k : k + n] for k in range(size)])
