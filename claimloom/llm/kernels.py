"""Vectorised hashing of words and word windows over the bytes of many texts at once.

Hashes are polynomials modulo 2**64 over random byte codes, taken from prefix
sums, so that every word and every window costs a few array operations however
long it is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_R, _S = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
#: Space, and the controls from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, ``n`` at least."""
    size = 1 << max(12, int(n).bit_length())
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more than rows).

    A word is a longest run of bytes that ``word_byte`` marks; it never crosses rows.
    """
    n = len(raw)
    inside = word_byte[raw]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One hash for each word's bytes."""
    up, down = powers(_R, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` consecutive words; callers drop windows that cross rows."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(_S, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return mixed((total[width:] - total[: n + 1 - width]) * down[: n + 1 - width] + np.uint64(width))


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the first word of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start, as many as its count."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
