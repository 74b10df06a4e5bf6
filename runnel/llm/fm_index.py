"""An FM-index over a sequence of small integers: suffix array, wavelet-tree ranks, backward search, sampled locate. Numpy only.

The sequence may hold many separators (symbol 0). Each separator counts as unique and smaller than all symbols, ordered by
position; patterns hold no separator. A walk to locate an occurrence ends at the latest where a separator stands before.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions have their suffix position stored.
SAMPLE = 8


def suffix_array(seq: np.ndarray, bits: int) -> np.ndarray:
    """Sorted suffixes by prefix doubling. seq ends with a separator; `bits` holds any symbol."""
    n, h = len(seq), max(1, 63 // bits)
    sep_at = np.flatnonzero(seq == 0)
    reach = sep_at[np.searchsorted(sep_at, np.arange(n))] - np.arange(n)  # symbols before the next separator
    padded = np.concatenate([seq, np.zeros(h, seq.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << bits) | np.where(reach > k, padded[k : n + k], 0)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    # equal keys that hold a separator are settled by position: the stable sort has done it
    new |= reach[order] < h
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            return order
        at = order[slots]
        second = rank[at + h]
        by = np.lexsort((at, second, rank[at]))
        at, first, second = at[by], rank[at[by]], second[by]
        order[slots] = at
        split = np.ones(len(at), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        split |= reach[at] < 2 * h
        new[slots] |= split
        rank[at] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        h *= 2


class WaveletTree:
    """A wavelet matrix: one bit plane a level, with counts of ones before each position of a block."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.planes, self.zeros = len(seq), [], []
        cur = seq
        for level in reversed(range(bits)):
            bit = ((cur >> level) & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """For each array of positions: occurrences of the symbols before them."""
        levels = len(self.planes)
        lo, at = np.zeros(len(symbol), np.int64), list(positions)
        for k, (ones, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = ((symbol >> (levels - 1 - k)) & 1).astype(bool)
            step = lambda p: np.where(bit, zeros + ones[p], p - ones[p])  # noqa: B023, E731
            lo, at = step(lo), [step(p) for p in at]
        return [p - lo for p in at]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and how many equal ones stand before."""
        symbol, lo, p = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at
        for ones, zeros in zip(self.planes, self.zeros, strict=True):
            bit = ones[p + 1] - ones[p]
            symbol = symbol * 2 + bit
            on = bit.astype(bool)
            lo, p = np.where(on, zeros + ones[lo], lo - ones[lo]), np.where(on, zeros + ones[p], p - ones[p])
        return symbol, p - lo


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int):
        """seq: symbols 1 to symbols - 1, and 0 as separator; it ends with a separator."""
        self.bits = max(1, int(symbols - 1).bit_length())
        sa = suffix_array(seq, self.bits)
        bwt = seq[sa - 1]
        self.tree = WaveletTree(bwt, self.bits)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        kept = (sa % SAMPLE == 0) | (bwt == 0)
        self.kept = kept
        self.place = np.cumsum(kept) - 1
        self.samples = sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that start with each pattern (rows of a matrix, right-aligned, lengths given)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.tree.n, np.int64)
        for k in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                continue
            c = patterns[live, -k]
            a, b = self.tree.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.starts[c] + a, self.starts[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix-array rows, by walking back to sampled ones."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            here = self.kept[rows[todo]]
            done = todo[here]
            out[done] = self.samples[self.place[rows[done]]] + steps
            todo = todo[~here]
            if len(todo):
                c, r = self.tree.access(rows[todo])
                rows[todo] = self.starts[c] + r
            steps += 1
        return out
