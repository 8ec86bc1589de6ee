"""FM-index of one shard of words: suffix order, wavelet-tree ranks, backward search and sampled locate."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start of every suffix in lexical order, by prefix doubling.

    Three symbols are packed into the first key. Later rounds sort only suffixes that still tie, so long repeats
    cost in proportion to their own length. The last symbol must occur once.
    """
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    width = int(symbols.max()).bit_length() + 1
    reach = max(1, min(3, 63 // width))
    key = np.zeros(n, dtype=np.int64)
    for i in range(reach):
        key <<= width
        key[: n - i] += symbols[i:].astype(np.int64) + 1
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, dtype=np.int64)
    # a suffix's rank is the place of the first of its ties
    places = np.flatnonzero(new)
    rank[order] = np.repeat(places, np.diff(places, append=n))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        suffixes = order[tied]
        after = suffixes + reach
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[suffixes]
        again = np.argsort(own * (n + 1) + follow)
        suffixes, own, follow = suffixes[again], own[again], follow[again]
        order[tied] = suffixes
        split = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        heads = np.flatnonzero(split)
        rank[suffixes] = np.repeat(tied[heads], np.diff(heads, append=len(tied)))
        tied = tied[~(split & np.append(split[1:], True))]
        reach *= 2
    return order


class Wavelet:
    """A wavelet tree in matrix form: one bit vector per bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)]).view(np.uint64)
            self.words.append(words)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(self.n - int(self.sums[-1][-1]))
            current = np.concatenate([current[~bits], current[bits]])

    def ones(self, level: int, upto: np.ndarray) -> np.ndarray:
        """Set bits of a level before each place."""
        word, bit = upto >> 6, (upto & 63).astype(np.uint64)
        inside = self.words[level][word] & ((_ONE << bit) - _ONE)
        return self.sums[level][word] + np.bitwise_count(inside)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        begin, end = np.zeros_like(upto), upto
        for level in range(self.levels):
            bit = (symbol >> (self.levels - 1 - level)) & 1
            b, e = self.ones(level, begin), self.ones(level, end)
            begin = np.where(bit, self.zeros[level] + b, begin - b)
            end = np.where(bit, self.zeros[level] + e, end - e)
        return end - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank before that place."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.levels):
            here = self.words[level][at >> 6] >> (at & 63).astype(np.uint64)
            bit = (here & _ONE).astype(np.int64)
            a, b = self.ones(level, at), self.ones(level, begin)
            at = np.where(bit, self.zeros[level] + a, at - a)
            begin = np.where(bit, self.zeros[level] + b, begin - b)
            symbol = (symbol << 1) | bit
        return symbol, at - begin


class FMIndex:
    """Search for phrases in a sequence of non-negative symbols whose last symbol occurs once."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        order = suffix_order(symbols)
        self.n, self.sample = len(symbols), sample
        self.tree = Wavelet(symbols[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.marked = np.flatnonzero(order % sample == 0)
        self.positions = order[self.marked]

    def count(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of every row of ``phrases`` (padded on the right), by backward search; a negative symbol
        occurs nowhere."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        high[lengths == 0] = 0
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - step]
            known = (symbol >= 0) & (symbol < len(self.before) - 1)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            start = self.before[symbol]
            low[live], high[live] = start + self.tree.rank(symbol, low[live]), start + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of the suffix in each row: step back until a sampled one is met."""
        out, steps = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_, at = np.arange(len(rows)), rows
        while len(open_):
            place = np.searchsorted(self.marked, at)
            met = self.marked[np.minimum(place, len(self.marked) - 1)] == at
            out[open_[met]] = self.positions[place[met]] + steps[open_[met]]
            open_, at = open_[~met], at[~met]
            symbol, rank = self.tree.access(at)
            at = self.before[symbol] + rank
            steps[open_] += 1
        return out
