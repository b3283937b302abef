"""Vectorised 64-bit hashes of words in a byte buffer."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Bytes whose words are hashed together; a longer word is hashed in one piece all the same.
STEP = 1 << 17
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, in place (fixed multipliers: the finaliser of MurmurHash3)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < max(n, 1):
        out = np.full(max(n, STEP), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def word_hashes(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word text[first:last], in order of place, from running sums of bytes times powers of an odd number."""
    out = np.empty(len(first), np.uint64)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(last, first[lo] + STEP, side="right")))
        a, b = first[lo:hi] - first[lo], last[lo:hi] - first[lo]
        part = text[first[lo] : last[hi - 1]].astype(np.uint64) + np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * powers(_ODD, len(part)))))
        out[lo:hi] = (total[b] - total[a]) * powers(_INVERSE, len(part) + 1)[a]
        lo = hi
    return mix(out)


def hash_longs(a: np.ndarray, seed: int | np.ndarray = 42) -> np.ndarray:
    """Spark's xxhash64 of longs, so that Python and the JVM deal rows alike (fixed values: the primes of XXH64).

    Of two columns it is that of the second with the first's as its seed.
    """
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(h: np.ndarray, n: int) -> np.ndarray:
        return h << np.uint64(n) | h >> np.uint64(64 - n)

    with np.errstate(over="ignore"):
        h = np.asarray(seed).astype(np.int64).view(np.uint64) + p5 + np.uint64(8) ^ turn(a.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return (h ^ h >> np.uint64(32)).view(np.int64)
