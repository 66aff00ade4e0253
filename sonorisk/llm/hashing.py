"""Vectorised 64-bit hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

# Odd multipliers.
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mixing of xor-shifts and odd products."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hash of each word, kept for ``limit`` words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), dtype=np.uint64, count=len(words))


class Powers:
    """Powers of an odd multiplier and of its inverse, grown on demand."""

    def __init__(self, which: int = 0):
        self.odd, self.up, self.down = _ODD[which], np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def runs(self, values: np.ndarray, length: int) -> np.ndarray:
        """Polynomial hash, modulo 2**64, of every run of ``length`` values."""
        n = len(values)
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, self.odd, dtype=np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, pow(self.odd, -1, 1 << 64), dtype=np.uint64)]))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * self.up[:n])])
        return (total[length:] - total[:-length]) * self.down[: n - length + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by minima over doubling widths."""
    least, k, n = values, 1, len(values) - width + 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    return np.minimum(least[:n], least[width - k : width - k + n])
