"""Operator 2 (sketches): HyperMinHash registers of shingle sets.

A set's hashes are dealt into ``REGISTERS`` buckets in rounds: round t gives
every element a bucket and a fraction, a bucket keeps its first round's least
fraction, and rounds go on until every bucket is filled (the last rounds fill
each bucket directly), so two sets agree in a bucket with the probability of
their Jaccard similarity, also when they are small.  What is stored of a bucket
is compressed to 16 bits: the fraction's leading zeros (4 bits) and the 11
mantissa bits that follow the first one; a bucket filled after the first round
stores 15 bits of its fraction beside a flag.
"""

from __future__ import annotations

import numpy as np
import xxhash

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Chance that two different minima give equal registers: the mantissas agree
#: (2**-11) and so do the leading zeros (about 1/3 for minima of one scale).
COLLISION = 2.0**-11 / 3

_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the whole sequence if it has fewer words than ``size``."""
    if not words:
        return np.zeros(0, np.uint64)
    h, n = word_hashes(words, known), min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _ODD + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16[REGISTERS] of a set that is not empty."""
    k, n = REGISTERS, len(shingles)
    least = np.full(k, np.iinfo(np.uint64).max, np.uint64)  # round << 54 | fraction of 54 bits
    step = max(1, 2048 // n)
    for t in range(0, k, step):
        rounds = np.arange(t, min(k, t + step), dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = mix(shingles[None, :] + (rounds[:, None] + np.uint64(1)) * _ODD)
        bucket = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        fraction = mix(h) >> np.uint64(10)
        np.minimum.at(least, bucket.ravel().astype(np.intp), (fraction | (rounds[:, None] << np.uint64(54))).ravel())
        if least.max() >> np.uint64(54) < k:
            break
    empty = np.flatnonzero(least >> np.uint64(54) >= k)
    for j in empty:
        with np.errstate(over="ignore"):
            h = mix(shingles + np.uint64(k + int(j) + 1) * _ODD)
        least[j] = (h.min() >> np.uint64(10)) | (np.uint64(k + int(j)) << np.uint64(54))
    fraction = least & np.uint64((1 << 54) - 1)
    # leading zeros of the 54-bit fraction: the exponent of its float, whose 53 bits hold the mantissa
    m, e = np.frexp((fraction | np.uint64(1)).astype(np.float64))
    zeros = np.minimum(54 - e, 15)
    mantissa = ((m - 0.5) * 2 * 2048).astype(np.uint16)
    first = (zeros.astype(np.uint16) << np.uint16(11)) | np.minimum(mantissa, 2047)
    later = np.uint16(0x8000) | (mix(least) >> np.uint64(49)).astype(np.uint16)
    return np.where(least >> np.uint64(54) == 0, first, later).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """int64[BANDS]: the hash of each band's registers."""
    x = regs.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(ROWS):
            out = mix(out * _ODD + x[:, c])
    return out.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (rows), corrected for equal registers of different minima."""
    agree = (a == b).mean(axis=-1)
    return np.clip((agree - COLLISION) / (1 - COLLISION), 0.0, 1.0)
