"""A minimal perfect hash over 128-bit keys, built and probed in whole arrays.

Level after level, keys that fall alone on a bit of the level's array stay there; the others go to the next level. A
key's index is the number of bits set before its own.
"""

from __future__ import annotations

import numpy as np

LEVELS, SPARE = 40, 1.6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(2 * level + 3)) ^ (np.uint64(level + 1) * _MIX)
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct keys (a[i], b[i]) -> 0..n-1; other keys -> any of these or -1."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.sizes: list[int] = []
        placed = 0
        for level in range(LEVELS):
            if not len(a):
                break
            size = max(64, int(len(a) * SPARE))
            at = _place(a, b, level, size)
            alone = np.bincount(at, minlength=size) == 1
            packed = np.packbits(alone, bitorder="little")
            ones = np.unpackbits(packed, bitorder="little").reshape(-1, 8).sum(1)
            self.bits.append(packed)
            self.before.append((placed + np.cumsum(ones) - ones).astype(np.uint32))
            self.sizes.append(size)
            placed += int(ones.sum())
            stay = ~alone[at]
            a, b = a[stay], b[stay]
        if len(a):
            raise ValueError("repeated keys")
        self.n = placed

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _place(a[open_], b[open_], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            word = self.bits[level][byte]
            hit = (word >> bit) & 1 == 1
            below = (word & ((np.uint8(1) << bit) - np.uint8(1)))[hit]
            ones = np.unpackbits(below[:, None], axis=1).sum(1) if len(below) else below
            out[open_[hit]] = self.before[level][byte[hit]].astype(np.int64) + ones
            open_ = open_[~hit]
        return out
