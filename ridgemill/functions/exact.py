"""Comparisons of sums of products that do not depend on the order of summation.

A factor is rounded to two whole numbers of `width` bits, relative to the largest
of its row or column. Products of those numbers, and sums of as many as there are
rows, are whole numbers that a double (or a 64-bit integer) holds exactly, so
every engine gets the same ones, whatever its blocks, tiles or joins. A sum is the
pair (high, low), which stands for high * 2**width + low.
"""

from __future__ import annotations

import numpy as np

#: Unit roundoff of a double.
UNIT = 2.0**-53


def width(n: int) -> int:
    """Bits of each number, for sums over `n` rows."""
    return (53 - int(n).bit_length()) // 2


def exponents(top: np.ndarray) -> np.ndarray:
    """The power of two above each value, 0 for 0."""
    return np.frexp(np.asarray(top, float))[1]


def halves(values: np.ndarray, exponent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two whole numbers of each value, as doubles."""
    scaled = np.ldexp(values, bits - exponent)
    first = np.rint(scaled)
    return first, np.rint(np.ldexp(scaled - first, bits))


def far(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The absolute value of sums, as pairs that compare in order: 0 <= low < 2**bits."""
    high, low = high.astype(np.int64), low.astype(np.int64)
    high, low = high + (low >> bits), low & ((1 << bits) - 1)
    below = high < 0
    borrowed = below & (low > 0)
    return np.where(below, -high - borrowed, high), np.where(borrowed, (1 << bits) - low, low)


def at_least(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a >= b, for pairs from `far`."""
    return (a[0] > b[0]) | (a[0] == b[0]) & (a[1] >= b[1])
