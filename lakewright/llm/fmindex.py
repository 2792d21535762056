"""A compressed FM-index over integer sequences: the BWT in a wavelet matrix, searched backwards for many patterns at once.

Once it is built it holds no suffix array: the wavelet matrix (a bit a level for each symbol and a
count for each 64 of them) and the suffix ranges of the repeated windows.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, rank of each by its first ``keep`` symbols), by prefix doubling.

    symbols are non-negative and the last is unique; keep is a power of two. Only suffixes that
    are not yet told apart are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    slots, rank, kept, h = np.arange(n, dtype=np.int32), np.empty(n, np.int32), None, 1
    key = symbols[order]
    while True:
        new = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        if h == keep:
            kept = rank.copy()
        if not len(slots):
            return order, rank if kept is None else kept
        at = order[slots]
        key = rank[at].astype(np.int64) * n + rank[at + h]
        by = np.argsort(key, kind="stable")
        key, order[slots] = key[by], at[by]
        h *= 2


class WaveletMatrix:
    """Ranks of symbols below 2**levels; a level is packed bits and a running count for each 64 of them."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), levels
        self.words, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.pad(bit, (0, 64 - len(bit) % 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            now = np.concatenate([now[~bit], now[bit]])

    def mapped(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where positions go when the sequence is sorted by symbol, down all levels, for these symbols."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below)
            bit = (symbols >> (self.levels - 1 - k)) & 1
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """symbols: 0 separates and ends sequences and is never searched; others are 1 to size - 1.

    low and high are the suffix ranges of the patterns of ``window`` symbols that stand more than
    once: they cut a longer pattern to its first ``window`` symbols.
    """

    def __init__(self, symbols: np.ndarray, size: int, window: int):
        ends = np.flatnonzero(symbols == 0)
        apart = symbols + np.int32(len(ends))
        apart[ends] = np.arange(len(ends))  # separators differ, so that no comparison goes past one
        h = 1 << (window.bit_length() - 1)
        order, rank = suffix_array(apart, h)
        del apart
        self.n = len(symbols)
        # Windows are equal where their first h and their last h symbols are.
        first, last = rank[order], rank[np.minimum(order + np.int32(window - h), self.n - 1)]
        new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])))
        after = np.append(new[1:], self.n)
        many = after - new > 1
        self.low, self.high = new[many].astype(np.int32), after[many].astype(np.int32)
        del first, last, rank, new, after
        self.matrix = WaveletMatrix(symbols[order - 1], max(1, (size - 1).bit_length()))
        of = np.arange(size)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))[:-1]]) - self.matrix.mapped(np.zeros(size, np.int64), of)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns with a symbol put before each."""
        both = self.matrix.mapped(np.concatenate([lo, hi]), np.concatenate([symbols, symbols])) + np.concatenate([self.starts[symbols]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def cut(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the repeated window or -1, its range) for patterns of a window or more that begin their ranges at lo."""
        if not len(self.low):
            return np.full(len(lo), -1), lo, lo + 1
        k = np.searchsorted(self.low, lo, "right") - 1
        inside = (k >= 0) & (lo < self.high[k])
        return np.where(inside, k, -1), np.where(inside, self.low[k], lo), np.where(inside, self.high[k], lo + 1)


def repeated_windows(sequences: np.ndarray, sizes: np.ndarray, size: int, window: int) -> np.ndarray:
    """For each position of the sequences (symbols from 1, one after the other, of the given sizes):
    a number that equal windows share, if the window that starts there, inside its sequence, stands
    more than once in all sequences; -1 if not.

    All sequences stream backwards through the index, a symbol a step: the range of what has been
    read is extended, and cut to a window where it grows longer, so matching statistics are known up
    to the threshold at every position, and windows whose range holds others are reported.
    """
    n, many = len(sequences), len(sizes)
    base = np.cumsum(sizes) - sizes + np.arange(many)  # with a separator after each
    text = np.zeros(n + many, np.int32)
    place = np.arange(n) + np.repeat(np.arange(many), sizes)
    text[place] = sequences
    index = FMIndex(text, size, window)
    of = np.full(n + many, -1, np.int32)
    own = sizes >= window
    at, left = base[own], sizes[own]
    read, lo, hi = 0, np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    while len(at):
        left, read = left - 1, read + 1
        lo, hi = index.extend(lo, hi, text[at + left])
        if read >= window:
            of[at + left], lo, hi = index.cut(lo)
        go = left > 0
        if not go.all():
            at, left, lo, hi = at[go], left[go], lo[go], hi[go]
    return of[place]
