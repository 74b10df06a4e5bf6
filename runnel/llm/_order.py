"""Sorting by several keys, one after another: multikey quicksort over numpy columns."""

from __future__ import annotations

import numpy as np

#: Below so many rows a stretch is sorted by all its remaining keys at once.
SMALL = 1 << 13


def multikey_quicksort(*columns: np.ndarray) -> np.ndarray:
    """The order of the rows by the columns, the first of them deciding first.

    A stretch whose rows agree up to a column is parted by a pivot's value in it: rows below, rows that have it, which go on with the next
    column, and rows above.
    """
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(columns):
            continue
        rows = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = rows[np.lexsort([c[rows] for c in columns[:depth:-1]] + [columns[depth][rows]])]
            continue
        values = columns[depth][rows]
        pivot = np.sort(values[:: max(1, len(values) // 15)])[7]
        below, above = values < pivot, values > pivot
        same = rows[~(below | above)]
        first, last = rows[below], rows[above]
        order[lo:hi] = np.concatenate([first, same, last])
        a, b = lo + len(first), lo + len(first) + len(same)
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def heads(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns are unlike the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def least_in_run(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row, the value at the head of its run."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1]
