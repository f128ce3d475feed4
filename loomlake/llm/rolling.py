"""Hashes of all substrings of a byte string from prefix sums, with numpy, modulo 2**64."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
#: A random number for each byte, and odd bases with their inverses.
TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = tuple(int(x) | 5 for x in _RNG.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each number's bits over all of it."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """of(begin, end): the mixed hash of data[begin:end], for arrays of places."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _powers(BASES[which], len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.down[begin]
        return mix(raw + (np.asarray(end) - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k bytes in a row, not told apart from other lengths."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)
