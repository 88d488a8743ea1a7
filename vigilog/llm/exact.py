"""Exact whole-number sums over rows of vectors, in numpy inside tasks and in Spark between them.

A sum is handed on as rows (keys, limb, value): it is the total of value * 2**(32 * limb), whatever
its size, so Spark can add the values of equal limbs as longs without loss.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIMB = 32
_MASK = (1 << _LIMB) - 1
#: Whole numbers below are exact as doubles, and as sums and products of longs.
EXACT_DOUBLE = 1 << 53
EXACT_LONG = 1 << 61
_PART = (1 << 21) - 1
#: Rows of which parts of 21 bits may be multiplied and added as longs.
_MOST_ROWS = 1 << 20


def largest(matrix: np.ndarray) -> int:
    """Largest absolute value, 0 for an empty matrix; exact for longs, also the least one."""
    if not matrix.size:
        return 0
    return max(int(matrix.max()), -int(matrix.min()))


def column_sums(matrix: np.ndarray) -> list[int]:
    """Sum of each column of longs or Python integers."""
    if matrix.dtype == object:
        return matrix.sum(axis=0).tolist() if len(matrix) else [0] * matrix.shape[1]
    high, low = (matrix >> _LIMB).sum(axis=0), (matrix & _MASK).sum(axis=0)
    return [(h << _LIMB) + x for h, x in zip(high.tolist(), low.tolist(), strict=True)]


def square_sums(matrix: np.ndarray) -> list[int]:
    """Sum of the squares of each column; longs must be below 2**62 in absolute value."""
    if matrix.dtype == object:
        return column_sums(matrix * matrix)
    most = largest(matrix)
    if most * most * len(matrix) < 1 << 63:
        return np.einsum("ij,ij->j", matrix, matrix).tolist()
    out = [0] * matrix.shape[1]
    for first in range(0, len(matrix), _MOST_ROWS):
        part = matrix[first : first + _MOST_ROWS]
        a, b, c = part >> 42, (part >> 21) & _PART, part & _PART
        products = [(a, a, 84), (a, b, 64), (a, c, 43), (b, b, 42), (b, c, 22), (c, c, 0)]
        for left, right, shift in products:
            for i, value in enumerate(np.einsum("ij,ij->j", left, right).tolist()):
                out[i] += value << shift
    return out


def limbs(totals: Iterable[int]) -> Iterator[tuple[int, int, int]]:
    """(place, limb, value) of each sum that is not zero; the highest limb bears the sign."""
    for place, total in enumerate(totals):
        limb = 0
        while total:
            last = -1 - _MASK <= total <= _MASK
            yield place, limb, total if last else total & _MASK
            total = 0 if last else total >> _LIMB
            limb += 1


def whole(rows: Iterable[tuple[int, int, int]], size: int) -> list[int]:
    """The sums that rows of (place, limb, value) stand for."""
    totals = [0] * size
    for place, limb, value in rows:
        totals[place] += value << (_LIMB * limb)
    return totals


def by_size(sizes: pa.Array, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of vector in a batch: the size, places of its rows, and their matrix."""
    for size in pc.unique(sizes).to_pylist():
        places = np.flatnonzero(pc.equal(sizes, size).to_numpy(zero_copy_only=False))
        rows = lists if len(places) == len(lists) else lists.take(pa.array(places))
        yield size, places, rows.flatten().to_numpy(zero_copy_only=False).reshape(len(places), size)
