"""FM-index over a shard's words: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class _Wavelet:
    """Ranks and access for numbers below 2 ** levels, one bit vector for each bit."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bit = (values >> level) & 1
            self.bits.append(_Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.base = self._down(np.zeros(1 << levels, dtype=np.int64), np.arange(1 << levels))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.levels))):
            ones = self.bits[i].ones(at)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(at, symbol) - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for i in range(self.levels):
            bit, ones = self.bits[i].get(at).astype(np.int64), self.bits[i].ones(at)
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return symbol, at - self.base[symbol]


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Order of suffixes by doubling. Every 0 is a separator of its own, so an order never depends on what follows one."""
    gaps = text == 0
    rank = np.where(gaps, np.cumsum(gaps), text.astype(np.int64) + int(gaps.sum()))
    step, n = 1, len(text)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        moved = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[1], 1 + np.cumsum(moved[1:] != moved[:-1])])
        if fresh[order[-1]] == n:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    """Searches phrases in a text of words 1 and up, in which 0 separates runs; the text ends with 0."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        order = _suffixes(text)
        last = text[order - 1]
        self.size = int(text.max()) + 1
        self.wavelet = _Wavelet(last.astype(np.int64), max(1, int(self.size - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        # The first word of every run is sampled: a walk back never crosses a separator.
        marked = (order % sample == 0) | (last == 0)
        self.marks, self.places = _Bits(marked), order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, which stand in reverse in the rows of ``phrases``."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.int64)
        active = np.flatnonzero((phrases < self.size).all(axis=1))
        low[active], high[active] = self.before[phrases[active, 0]], self.before[phrases[active, 0] + 1]
        for step in range(1, phrases.shape[1]):
            active = active[(low[active] < high[active])]
            active = active[lengths[active] > step] if len(active) else active
            if not len(active):
                break
            word = phrases[active, step]
            low[active] = self.before[word] + self.wavelet.rank(word, low[active])
            high[active] = self.before[word] + self.wavelet.rank(word, high[active])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffix rows, walking back to a sampled one."""
        rows, steps, place = rows.copy(), 0, np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            found = self.marks.get(at).astype(bool)
            place[open_[found]] = self.places[self.marks.ones(at[found])] + steps
            open_ = open_[~found]
            word, rank = self.wavelet.access(rows[open_])
            rows[open_] = self.before[word] + rank
            steps += 1
        return place
