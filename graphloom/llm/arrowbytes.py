"""Byte-level helpers for Arrow batches of texts: chunks, word bounds, hashes.

All hashing is vectorised over whole chunks of concatenated UTF-8 text; a
chunk holds at most ``CHUNK`` bytes, or one document that is larger.
"""

from __future__ import annotations

import numpy as np

from graphloom.llm.common import worker_cache

CHUNK = 2_000_000


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bounds, raw


def chunks(bounds: np.ndarray, limit: int = CHUNK):
    """Ranges (first, last) of documents with at most ``limit`` bytes together."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_bounds(is_word: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes; a document's start splits a run."""
    n = len(is_word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[starts_of_docs[starts_of_docs < n]] = True
    fresh[n] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | fresh[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | fresh[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        return have

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._grow(self.up, self.base, n), self._grow(self.down, self.inverse, n)
        return self.up[:n], self.down[:n]


class Hasher:
    """64-bit hashes of words and of windows of consecutive words."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.by_byte, self.by_word = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(starts) == 0:
            return np.zeros(0, np.uint64)
        up, down = self.by_byte.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words; entry i starts at word i."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = self.by_word.get(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def hasher() -> Hasher:
    cache = worker_cache()
    if "hasher" not in cache:
        cache["hasher"] = Hasher()
    return cache["hasher"]
