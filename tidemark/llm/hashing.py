"""Hashes of many spans of one sequence by running sums."""

from __future__ import annotations

import numpy as np
import xxhash

from tidemark.llm.common import CACHES, mix64

_rng = np.random.default_rng(20)
#: A random value for each byte.
BYTE = _rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64)
#: Words from so many bytes on get a hash of their own: sums modulo 2**64 have known collisions between long words.
LONG = 64
_BASE = _rng.integers(1 << 62, 1 << 63, 3, dtype=np.uint64) & ~np.uint64(7) | np.uint64(5)
#: And another one.
OTHER = _rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64)


class _Powers:
    """Powers of the bases and of their inverses modulo 2**64, as many as were needed so far."""

    up = [np.ones(1, np.uint64)] * 3
    down = [np.ones(1, np.uint64)] * 3

    @classmethod
    def of(cls, k: int, n: int):
        if n >= len(cls.up[k]):
            m = max(1 << 16, n + n // 4)
            for table, b in ((cls.up, int(_BASE[k])), (cls.down, pow(int(_BASE[k]), -1, 1 << 64))):
                x = np.full(m + 1, b, np.uint64)
                x[0] = 1
                table[k] = np.cumprod(x, dtype=np.uint64)
        return cls.up[k], cls.down[k]

    @classmethod
    def clear(cls):
        cls.up, cls.down = ([np.ones(1, np.uint64)] * 3 for _ in range(2))


CACHES.append(_Powers.clear)


class Sums:
    """Hashes of spans of a sequence of 64-bit values, from running sums of value times power."""

    def __init__(self, k: int, values: np.ndarray):
        up, self.down = _Powers.of(k, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes for each word data[start:end]."""
    one, two = Sums(0, BYTE[data]).span(start, end), Sums(1, OTHER[data]).span(start, end)
    for i in np.flatnonzero(end - start >= LONG):
        h = xxhash.xxh3_128_intdigest(data[start[i] : end[i]])
        one[i], two[i] = h & (1 << 64) - 1, h >> 64
    return one, two


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each word data[start:end]."""
    out = Sums(0, BYTE[data]).span(start, end)
    for i in np.flatnonzero(end - start >= LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out
