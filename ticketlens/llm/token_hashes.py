"""Hashes of words and of runs of words, for the operators on shingles and
word windows. Words are hashed in the JVM; runs are hashed in numpy with
prefix sums, so a run of any length costs the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.llm.common import words

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2 ** 64)


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per word of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


class Runs:
    """Hashes of runs of the given word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(hashes) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def each(self, length: int) -> np.ndarray:
        """The runs of one length at every place where one fits."""
        return mix((self.sums[length:] - self.sums[:len(self.sums) - length]) * self.back[:len(self.sums) - length])

    def at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + length.astype(np.uint64))


def list_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of an Arrow list<int64> column."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
