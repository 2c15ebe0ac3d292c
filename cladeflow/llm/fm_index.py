"""An FM-index over word numbers: suffix order, wavelet ranks, backward search and sampled positions."""

from __future__ import annotations

import numpy as np

EVERY = 16      # one of so many positions is kept with its row


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Rows of all suffixes of ``text``, whose last symbol is 0; every 0 is a separator of its own.

    Ranks double in length; only suffixes that still share a rank are sorted again.
    """
    size, stops = len(text), text == 0
    start = np.where(stops, np.cumsum(stops) - 1, text.astype(np.int64) + int(stops.sum()))
    order = np.argsort(start, kind="stable")
    rank = np.empty(size, np.int64)
    lead = np.flatnonzero(np.diff(start[order], prepend=-1))
    rank[order] = np.repeat(lead, np.diff(np.append(lead, size)))
    step, rows = 1, np.flatnonzero(_shared(lead, size))
    while len(rows):
        at = order[rows]
        mine, then = rank[at], rank[at + step]
        by = np.argsort(mine * size + then, kind="stable")
        at, mine, then = at[by], mine[by], then[by]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (then[1:] != then[:-1])
        lead = np.flatnonzero(new)
        rank[at] = np.repeat(rows[lead], np.diff(np.append(lead, len(rows))))
        rows = rows[_shared(lead, len(rows))]
        step *= 2
    return order


def _shared(lead: np.ndarray, size: int) -> np.ndarray:
    """Which entries are in a group of two or more, from where groups begin."""
    counts = np.diff(np.append(lead, size))
    return np.repeat(counts > 1, counts)


class Bits:
    """A bit vector with rank, packed into words of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The bit of each position."""
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix: one bit vector for each bit of a symbol, most significant first."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in reversed(range(self.depth)):
            bit = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.start = self._down(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.depth))):
            ones = self.levels[i].rank(at)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of one shard; 0 ends every stretch of ``text``, and the text ends with 0."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        order = suffix_order(text)
        self.last = np.where(order > 0, text[order - 1], 0)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.ranks = Wavelet(self.last, alphabet)
        sampled = (order % EVERY == 0) | (self.last == 0)        # a stretch's first word, so no walk meets a separator
        self.sampled, self.places = Bits(sampled), order[sampled]

    def back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row reached from ``row`` when ``symbol`` is put before it."""
        return self.below[symbol] + self.ranks.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases of one length: those that occur, with their first and last row."""
        alive = np.arange(len(phrases))
        symbol = phrases[:, -1]
        low, high = self.below[symbol], self.below[symbol + 1]
        for j in reversed(range(phrases.shape[1] - 1)):
            there = low < high
            alive, low, high = alive[there], low[there], high[there]
            symbol = phrases[alive, j]
            low, high = self.back(symbol, low), self.back(symbol, high)
        there = low < high
        return alive[there], low[there], high[there]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled one."""
        out, row, steps, left = np.empty(len(rows), np.int64), rows, 0, np.arange(len(rows))
        while len(left):
            hit = self.sampled.get(row)
            out[left[hit]] = self.places[self.sampled.rank(row[hit])] + steps
            left, row = left[~hit], row[~hit]
            row = self.back(self.last[row], row)
            steps += 1
        return out
