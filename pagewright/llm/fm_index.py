"""An FM-index over a shard of words: suffix order, wavelet ranks, backward search, sampled positions.

Symbols are whole numbers; zero parts runs of symbols.  Each zero counts as a
symbol of its own, smaller than all others, so suffixes differ at the next zero
at the latest; patterns hold no zero.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions one is kept; the first of a run is always kept.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of ``symbols`` (the last one zero) in the order of their suffixes, by prefix doubling."""
    n = len(symbols)
    zero = symbols == 0
    zeros = int(zero.sum())
    values = np.where(zero, np.cumsum(zero) - 1, symbols + (zeros - 1)).astype(np.int64)
    bits = int(values.max() + 1).bit_length()
    depth = max(1, 62 // bits)
    key = values.copy()
    for k in range(1, depth):
        key <<= bits
        key[: max(n - k, 0)] |= values[k:]
    order = np.argsort(key, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    key = key[order]
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[order[slots]] = first
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order
        here = order[slots]
        key = rank[here] * n + rank[here + depth]
        by = np.argsort(key, kind="stable")
        order[slots], key = here[by], key[by]
        depth *= 2


class WaveletMatrix:
    """Ranks over an array of symbols below 2 ** levels."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        current = values
        for level in range(levels - 1, -1, -1):
            bit = (current >> level) & 1 == 1
            count = np.zeros(len(current) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(current) - int(count[-1]))
            current = np.concatenate((current[~bit], current[bit]))

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` comes to lie when ``symbol`` is followed through all levels."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[i][at]
            at = np.where((symbol >> level) & 1 == 1, self.zeros[i] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at``, and where these places come to lie."""
        symbol = np.zeros(len(at), np.int64)
        for i in range(self.levels):
            ones = self.ones[i][at]
            bit = self.ones[i][at + 1] - ones == 1
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return symbol, at


class FMIndex:
    """Counts and locates patterns in ``symbols`` (values up to ``largest``; the last one zero)."""

    def __init__(self, symbols: np.ndarray, largest: int):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.size = len(symbols)
        self.wavelet = WaveletMatrix(last, max(1, int(largest).bit_length()))
        every = np.arange(largest + 2)
        self.before = np.searchsorted(np.sort(symbols), every)
        self.bottom = self.wavelet.follow(every[:-1], np.zeros(largest + 1, np.int64))
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept, self.kept_upto, self.positions = kept, np.cumsum(kept) - 1, order[kept]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.follow(symbol, at) - self.bottom[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern, by backward search of all patterns at once.

        ``patterns`` has a row each, filled up behind with anything.
        """
        low, high = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        last = patterns[np.arange(len(lengths)), lengths - 1]
        low[:], high[:] = self.before[last], self.before[last + 1]
        open_ = np.flatnonzero((high > low) & (lengths > 1))
        at = lengths - 2
        while len(open_):
            symbol = patterns[open_, at[open_]]
            low[open_], high[open_] = self._step(symbol, low[open_]), self._step(symbol, high[open_])
            at[open_] -= 1
            open_ = open_[(high[open_] > low[open_]) & (at[open_] >= 0)]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row: steps back to a kept position, plus the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            symbol, at = self.wavelet.access(rows[open_])
            rows[open_] = self.before[symbol] + at - self.bottom[symbol]
            steps[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.positions[self.kept_upto[rows]] + steps
