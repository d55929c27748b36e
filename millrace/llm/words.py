"""Hashes of the words and word shingles of whole texts, a slice of documents at a time.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2 ** 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def scramble(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close values come to lie far apart."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * MIX_1
        values = (values ^ (values >> np.uint64(27))) * MIX_2
        return values ^ (values >> np.uint64(31))


_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * GOLDEN)[_LOWER]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for positions 0 to n at least."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 21)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that lie between the offsets; number of the first word of each text, and of all."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = _powers_to(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return scramble(hashes), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of the whole if it has fewer; none if it has no word."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    with np.errstate(over="ignore"):
        total = np.full(len(hashes) - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            total = scramble(total * GOLDEN + hashes[k : len(hashes) - width + 1 + k])
    return total
