"""Operator 8 (anchors): every byte window of a text by the least k-gram in it.

Windows of ``length`` bytes are equal only if their least k-gram (by a hash,
leftmost first) is equal and lies at the same place in them.  So the windows of
a text, taken by runs that share such an anchor, need to be compared only
with runs whose anchor has the same hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

GRAM = 32
_TABLE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
#: Bytes scanned at once: places fit into the low 20 bits.
PIECE = 1 << 20
_LOW = np.uint64(PIECE - 1)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(PIECE + 1, _STEP, np.uint64), np.full(PIECE + 1, _STEP_INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any range of a piece, from its prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[data] * up[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes] | None:
    """Of a piece: (anchor hash, anchor place, first window, windows) of each run."""
    if len(data) < length:
        return None
    hashes = Hashes(data)
    grams = hashes.grams(GRAM)
    width = length - GRAM + 1
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    place = (least & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(place)]]))
    at = place[first]
    return grams[at], at, first, count, hashes
