"""An FM-index over a sequence of small integers, in numpy: suffix order, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of `symbols`, whose last entry is 0. Each 0 is a border: borders sort first, by position, and
    end every comparison, so repeated texts cost no more rounds than their longest border-free stretch."""
    n = len(symbols)
    border = symbols == 0
    borders = int(border.sum())
    key = np.where(border, np.cumsum(border) - 1, borders - 1 + symbols).astype(np.uint64)
    bits = max(1, int(key.max()).bit_length())
    depth = min(n, max(1, 63 // bits))
    packed = np.zeros(n, np.uint64)
    for j in range(depth):
        packed <<= np.uint64(bits)
        packed[: n - j] |= key[j:]
    order = np.argsort(packed)
    in_order = packed[order]
    new = np.ones(n, bool)
    new[1:] = in_order[1:] != in_order[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    alone = new & np.concatenate((new[1:], [True]))
    slots = np.flatnonzero(~alone)
    while len(slots):  # only suffixes that still tie are sorted again, by twice the depth
        at = order[slots]
        both = rank[at].astype(np.uint64) * np.uint64(n) + rank[at + depth].astype(np.uint64)
        by = np.argsort(both)
        order[slots], both = at[by], both[by]
        new = np.ones(len(slots), bool)
        new[1:] = both[1:] != both[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        depth *= 2
    return order


class FMIndex:
    """Counts and locates patterns of symbols 1..top in a text over 0..top that ends with 0; 0 is in no pattern."""

    def __init__(self, symbols: np.ndarray, top: int, every: int = 8):
        n = len(symbols)
        order = suffix_order(symbols)
        before = np.concatenate((symbols[-1:], symbols[:-1]))[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))[: top + 1]
        self.levels, current = [], before
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (current >> bit & 1).astype(bool)
            counted = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=counted[1:])
            self.levels.append((bit, counted, n - int(counted[-1])))
            current = np.concatenate((current[~ones], current[ones]))
        self.start = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))
        # Kept: every so many positions, and wherever a border stands before, as no step leads across one.
        kept = (order % every == 0) | (before == 0)
        self.kept = np.zeros(n + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.places = order[kept].astype(np.int32)
        self.n = n

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            on = ones[row]
            row = np.where(symbol >> bit & 1, zeros + on, row - on)
        return row

    def before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Backward step: rows of suffixes that begin with `symbol` and go on as those above `row`."""
        return self.first[symbol] + self._descend(symbol, row) - self.start[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of rows of each pattern (rows of a matrix, filled from the left), all stepped together."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > j) & (low < high))
            symbol = patterns[live, j]
            low[live], high[live] = self.before(symbol, low[live]), self.before(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps back to the next kept one."""
        out, walk, steps, left = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(left):
            kept = self.kept[walk + 1] > self.kept[walk]
            out[left[kept]] = self.places[self.kept[walk[kept]]] + steps
            left, walk = left[~kept], walk[~kept]
            row, symbol = walk, np.zeros(len(walk), np.int64)
            for bit, ones, zeros in self.levels:
                on = ones[row]
                one = ones[row + 1] > on
                symbol |= one.astype(np.int64) << bit
                row = np.where(one, zeros + on, row - on)
            walk = self.first[symbol] + row - self.start[symbol]
            steps += 1
        return out
