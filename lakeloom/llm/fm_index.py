"""An FM-index over a sequence of word ids: wavelet matrix ranks, backward search, sampled positions.

Id 0 separates runs of words and is never searched for. Separators count as different from one another, so
suffixes are told apart within a run and sorting ends after log2 of the longest run; walks to a sampled
position end at the start of a run at the latest, as those are all sampled.
"""

from __future__ import annotations

import numpy as np


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling."""
    n = len(sequence)
    separators = np.flatnonzero(sequence == 0)
    rank = sequence.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit vector with prefix counts for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            bit = (sequence >> level & 1).astype(bool)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(sequence) - self.ones[-1][-1]))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """For each array of places: how often ``symbol`` occurs before them."""
        at = [np.zeros(len(symbol), np.int64), *places]
        for depth, level in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[depth], self.zeros[depth]
            up = (symbol >> level & 1).astype(bool)
            for k, place in enumerate(at):
                count = ones[place]
                at[k] = np.where(up, zeros + count, place - count)
        return [x - at[0] for x in at[1:]]

    def symbol(self, place: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        out = np.zeros(len(place), np.int64)
        for depth in range(self.bits):
            ones = self.ones[depth]
            count = ones[place]
            up = ones[place + 1] > count
            out = out << 1 | up
            place = np.where(up, self.zeros[depth] + count, place - count)
        return out


class FMIndex:
    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = 8):
        """``sequence``: ids from 0 to ``symbols`` - 1, with 0 as its first and last element."""
        n = len(sequence)
        order = suffix_array(sequence)
        before = sequence[order - 1]  # of the first position: the last, a separator
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=symbols))))
        self.tree = WaveletMatrix(before, max(1, int(symbols - 1).bit_length()))
        starts = np.zeros(n, bool)
        starts[1:] = sequence[:-1] == 0
        marked = (order % sample == 0) | starts[order] | (sequence[order] == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.positions = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each pattern (rows, padded to the right)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.first[-1], np.int64)
        live = np.arange(len(patterns))
        for back in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > back) & (high[live] > low[live])]
            symbol = patterns[live, lengths[live] - 1 - back]
            a, b = self.tree.rank(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a, self.first[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of these suffixes, by walking back to sampled ones."""
        out = np.empty(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(live):
            at = rows[live]
            known = self.marks[at + 1] > self.marks[at]
            done = live[known]
            out[done] = self.positions[self.marks[rows[done]]] + steps
            live = live[~known]
            at = rows[live]
            symbol = self.tree.symbol(at)
            rows[live] = self.first[symbol] + self.tree.rank(symbol, at)[0]
            steps += 1
        return out
