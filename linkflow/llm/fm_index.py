"""A compressed FM-index over integer symbols in numpy: suffix order, BWT in a wavelet matrix, range minima.

Batches of patterns are extended backwards together: every operation takes arrays, one
entry per pattern.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions sorted by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        key = rank * (n + 1)
        key[:-k or None] += rank[k:] + 1
        order = np.argsort(key)
        key = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Bits:
    """A bit vector in 64-bit words with the number of ones before every word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)


class FMIndex:
    """Index of ``text`` (symbols 0..size-1) for patterns of up to ``depth`` symbols.

    ``order_key`` gives every text position a rank; ``lowest`` finds the smallest rank among
    the occurrences in an interval.
    """

    def __init__(self, text: np.ndarray, depth: int, order_key: np.ndarray):
        self.n, size = len(text), int(text.max()) + 1
        sa = suffix_order(text, depth)
        bwt = text[sa - 1]
        self.levels = []
        for level in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> level) & 1
            bits = Bits(bit)
            zeros = int(self.n - bit.sum())
            self.levels.append((level, bits, zeros))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        symbols = np.arange(size)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:-1]
        self.base = smaller - self._down(symbols, np.zeros(size, np.int64))
        table = [order_key[sa].astype(np.int32)]
        while 2 ** len(table) <= self.n:
            half = 2 ** (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.lows = table
        self.flat = np.concatenate(table)
        self.at = np.cumsum([0] + [len(t) for t in table])[:-1]
        self.log = np.zeros(self.n + 2, np.int8)
        for k in range(1, len(table)):
            self.log[2 ** k:] = k

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the BWT arrives below all levels, on the path of ``symbol``."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Intervals of the patterns with ``symbol`` put in front (one backward step)."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base, n = self.base[symbol], len(symbol)
        return base + both[:n], base + both[n:]

    def lowest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest order key among the occurrences in each non-empty interval."""
        k = self.log[hi - lo].astype(np.int64)
        at = self.at[k]
        return np.minimum(self.flat[at + lo], self.flat[at + hi - (1 << k)])


def repeated_spans(pieces: list[np.ndarray], order: list[np.ndarray], least: int) -> list[list[tuple[int, int]]]:
    """For each piece the spans covered by windows of ``least`` symbols that occur earlier.

    order[p][i] is the place of symbol i of piece p among all documents (equal places are the
    same symbol of the same document). An occurrence is earlier if its first symbol's place
    is smaller. Matching statistics by backward search: a span [s, e] is matched from its end;
    where symbol x - 1 cannot be put in front any more, no window holding [x - 1, e] occurs
    earlier, so all of them are passed over at once.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    depth = int(size.max())
    text = np.zeros(int(size.sum()) + len(pieces), np.int64)     # symbol 0 ends a piece
    begin = np.cumsum(size + 1) - size - 1
    for p, b in zip(pieces, begin):
        text[b:b + len(p)] = p
    place = np.full(len(text), np.iinfo(np.int64).max)
    for o, b in zip(order, begin):
        place[b:b + len(o)] = o
    key = np.unique(place, return_inverse=True)[1]
    index = FMIndex(text, depth, key)
    found: list[list[tuple[int, int]]] = [[] for _ in pieces]
    live = np.flatnonzero(size >= least)
    s, e = np.zeros(len(pieces), np.int64), size - 1
    at, lo, hi = e.copy(), np.zeros(len(pieces), np.int64), np.full(len(pieces), index.n)
    while len(live):
        pos = begin[live] + at[live]
        a, b = index.extend(text[pos], lo[live], hi[live])
        some = b > a
        ok = np.zeros(len(live), bool)
        ok[some] = index.lowest(a[some], b[some]) < key[pos[some]]
        lo[live], hi[live] = a, b
        go = live[ok]
        at[go] -= 1
        ended = np.concatenate([live[~ok], go[at[go] < s[go]]])
        if len(ended):
            for p in ended.tolist():
                x, first, last = int(at[p]) + 1, int(s[p]), int(e[p])   # [x, last] occurs earlier
                if last - x + 1 >= least:
                    found[p].append((x, last + 1))
                if x <= first:                       # the whole span does
                    s[p], e[p] = last - least + 2, last + 1
                elif last == first + least - 1:      # one window does not
                    s[p], e[p] = x, size[p] - 1
                elif x - 2 >= first + least - 1:     # a long span does not: the part before the break
                    e[p] = x - 2
                else:
                    e[p] = first + least - 1
            at[ended], lo[ended], hi[ended] = e[ended], 0, index.n
            done = ended[(s[ended] > size[ended] - least) | (e[ended] >= size[ended])]
            live = np.setdiff1d(live, done, assume_unique=True)
    return found
