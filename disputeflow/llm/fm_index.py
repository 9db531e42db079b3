"""An FM-index over a sequence of word numbers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

#: Text positions whose place is kept; others are found by walking back to one of them.
SAMPLED = 16
LOCATED_AT_ONCE = 1 << 19


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling the compared prefix."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    span = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(n - span, 0)] = rank[span:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        span *= 2
        if n == 0 or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """The levels of a wavelet tree: for each bit of a symbol, counts of ones up to a place."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels = []
        for bit in reversed(range(bits)):
            ones = (sequence >> bit) & 1
            counts = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, counts, len(sequence) - int(counts[-1])))
            sequence = np.concatenate((sequence[ones == 0], sequence[ones == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``place``."""
        start = np.zeros_like(place)
        for bit, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            place = np.where(one, zeros + counts[place], place - counts[place])
            start = np.where(one, zeros + counts[start], start - counts[start])
        return place - start

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``place`` and how often it occurs before."""
        symbol, start = np.zeros_like(place), np.zeros_like(place)
        for bit, counts, zeros in self.levels:
            one = counts[place + 1] > counts[place]
            symbol |= one.astype(place.dtype) << bit
            place = np.where(one, zeros + counts[place], place - counts[place])
            start = np.where(one, zeros + counts[start], start - counts[start])
        return symbol, place - start


class FMIndex:
    """``text`` holds symbols from 1 to ``largest``."""

    def __init__(self, text: np.ndarray, largest: int) -> None:
        ended = np.append(text.astype(np.int64), 0)
        order = suffix_array(ended)
        before = ended[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(ended, minlength=largest + 2))))
        self.tree = WaveletMatrix(before, max(int(largest).bit_length(), 1))
        sampled = order % SAMPLED == 0
        self.sampled = sampled
        self.count = np.concatenate(([0], np.cumsum(sampled)))
        self.places = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each phrase, by backward search of all phrases."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled), np.int64)
        for step in range(int(lengths.max(initial=0))):
            active = np.flatnonzero((lengths > step) & (low < high))
            if not len(active):
                break
            symbol = phrases[active, lengths[active] - 1 - step]
            low[active] = self.below[symbol] + self.tree.rank(symbol, low[active])
            high[active] = self.below[symbol] + self.tree.rank(symbol, high[active])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled position, and that position."""
        out, todo, row = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(todo):
            here = self.sampled[row]
            out[todo[here]] = self.places[self.count[row[here]]] + steps
            todo, row = todo[~here], row[~here]
            symbol, rank = self.tree.access(row)
            row = self.below[symbol] + rank
            steps += 1
        return out
