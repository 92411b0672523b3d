"""Words and their hashes inside Arrow batches.

``bytes.split`` cuts exactly at space, tab, line feed, vertical tab, form feed and
carriage return, and ``bytes.lower`` changes exactly A-Z, which is what the
operators define; the same methods of ``str`` do more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Hash multiplier; odd, so powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CACHE_WORDS = 1 << 18


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 texts of an Arrow string column, a few at a time; null becomes the empty text."""
    raw = column.cast(pa.large_binary())
    for at in range(0, len(raw), 64):
        for x in raw.slice(at, 64).to_pylist():
            yield x or b""


def scramble(h: np.ndarray) -> np.ndarray:
    """Bijective finisher, so that high and low bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of any run of words from prefix sums: sum of h[j] * BASE**(j - start)."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Runs._powers) <= n:
            size = max(n + 1, 2 * len(Runs._powers), 4096)
            with np.errstate(over="ignore"):
                Runs._powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE)]))
                Runs._inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE_INVERSE)]))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * Runs._powers[:n], out=self.sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        """Of every run of ``size`` words."""
        raw = self.sums[size:] - self.sums[: len(self.sums) - size]
        return scramble(raw * Runs._inverses[: len(raw)])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs [start, end), their length included."""
        raw = (self.sums[end] - self.sums[start]) * Runs._inverses[start]
        return scramble(raw + (end - start).astype(np.uint64))


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())
