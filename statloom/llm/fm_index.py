"""A compressed full-text index over sequences of numbers: suffix order, and backward search over a wavelet tree.

The tree holds the Burrows-Wheeler transform and has the shape of a Huffman code, so that a symbol of frequency p
takes about log2(1 / p) bits and as many steps.  A level is a row of bits with a count of ones before every 64th.
Suffixes are ordered by their first `depth` symbols only, which is enough for patterns of up to `depth` symbols.
All searches run for whole arrays of patterns at a time.
"""

from __future__ import annotations

import numpy as np

from statloom.llm.huffman import code_lengths

LONGEST_CODE = 20


class Bits:
    """A row of bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class WaveletTree:
    """How often a symbol occurs before a place of a row of symbols 0 .. n_symbols - 1."""

    def __init__(self, row: np.ndarray, n_symbols: int):
        counts = np.bincount(row, minlength=n_symbols)
        self.size = code_lengths(counts, LONGEST_CODE).astype(np.int64)
        top = max(int(self.size.max(initial=0)), 1)
        order = np.lexsort((np.arange(n_symbols), self.size))  # canonical: shorter codes first
        order = order[self.size[order] > 0]
        widths = np.int64(1) << (top - self.size[order])
        self.code = np.zeros(n_symbols, dtype=np.int64)
        self.code[order] = np.cumsum(widths) - widths  # left-aligned to `top` bits
        self.top = top
        starts = np.cumsum(counts[order]) - counts[order]
        code, size = self.code[order], self.size[order]
        self.levels: list[Bits] = []
        self.node = np.zeros((top, n_symbols), dtype=np.int64)
        self.ones = np.zeros((top, n_symbols), dtype=np.int64)
        for level in range(top):
            row = row[self.size[row] > level]
            if level:
                row = row[np.argsort((self.code[row] >> (top - level)).astype(np.uint32), kind="stable")]
            bits = Bits(((self.code[row] >> (top - level - 1)) & 1).astype(bool))
            alive = int(np.searchsorted(size, level, side="right"))
            if alive == len(order):
                break
            prefix = code[alive:] >> (top - level)
            begin = starts[alive:][np.searchsorted(prefix, prefix)] - starts[alive]
            self.node[level, order[alive:]] = begin
            self.ones[level, order[alive:]] = bits.rank(begin)
            self.levels.append(bits)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before place at[i]; every symbol must occur in the row."""
        out = at.astype(np.int64)
        live, s, p = np.arange(len(out)), symbol, out.copy()
        for level, bits in enumerate(self.levels):
            if level:
                more = self.size[s] > level
                if not more.all():
                    out[live[~more]] = p[~more]
                    live, s, p = live[more], s[more], p[more]
            ones = bits.rank(self.node[level][s] + p) - self.ones[level][s]
            p = np.where((self.code[s] >> (self.top - level - 1)) & 1, ones, p - ones)
        out[live] = p
        return out


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs of keys."""
    key = keys[0] if len(keys) == 1 else keys[0] * (keys[1].max(initial=0) + 1) + keys[1]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """x moved n places ahead; 0 beyond the end."""
    out = np.zeros_like(x)
    out[: max(len(x) - n, 0)] = x[n:] + 1
    return out


class FmIndex:
    """Index of a row of symbols in which 0 ends every sequence; patterns do not hold 0 and have `depth` symbols at most.

    Every place carries a number; the smallest number of a pattern's places can be asked for.
    """

    def __init__(self, row: np.ndarray, numbers: np.ndarray, depth: int):
        n = len(row)
        self.depth, self.n = depth, n
        ranks = {1: _ranked(row)}
        reach = 1
        while 2 * reach < depth:
            ranks[2 * reach] = _ranked(ranks[reach], _ahead(ranks[reach], reach))
            reach *= 2
        # ranks by the first depth - 1 symbols, and by the first `depth`, from two overlapping stretches
        shorter = _ranked(ranks[reach], _ahead(ranks[reach], depth - 1 - reach)) if depth - 1 > reach else ranks[reach]
        whole = _ranked(ranks[reach], _ahead(ranks[reach], depth - reach)) if depth > reach else ranks[reach]
        del ranks
        order = np.argsort(whole, kind="stable")
        self.n_symbols = int(row.max(initial=0)) + 1
        self.tree = WaveletTree(np.concatenate([row[-1:], row[:-1]])[order] if n else row, self.n_symbols)
        self.counts = np.bincount(row, minlength=self.n_symbols)
        self.base = np.cumsum(self.counts) - self.counts
        # stretches of places that agree in depth - 1 symbols, and the smallest number where `depth` symbols agree
        new = np.flatnonzero(np.concatenate([[True], np.diff(shorter[order]) != 0])) if n else np.zeros(0, dtype=np.int64)
        self.stretch = np.append(new, n)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(whole[order]) != 0])) if n else np.zeros(0, dtype=np.int64)
        self.least_at = starts
        self.least_of = np.minimum.reduceat(numbers[order], starts) if n else numbers

    def longer(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of symbol + pattern, from those of the pattern."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.base[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def shorter(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the first depth - 1 symbols of a pattern of `depth` symbols."""
        at = np.searchsorted(self.stretch, low, side="right")
        return self.stretch[at - 1], self.stretch[at]

    def least(self, low: np.ndarray) -> np.ndarray:
        """The smallest number of the places of a pattern of `depth` symbols."""
        return self.least_of[np.searchsorted(self.least_at, low, side="right") - 1]

    def least_of_windows(self, row: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
        """For sequences row[first : first + size], and each of their windows of `depth` symbols, the smallest number
        of that window in the index (largest int64 if it has none); one row of `most` windows per sequence.

        Every sequence is read from its end to its beginning: the matching stretch grows by one symbol, and once it
        has `depth` symbols it loses its last one before it grows again.  Where it cannot grow, reading starts anew
        one symbol before the stretch's end; that does not happen in sequences that are in the index themselves.
        """
        out = np.full((len(first), most), np.iinfo(np.int64).max)
        low, high = np.zeros(len(first), dtype=np.int64), np.full(len(first), self.n)
        matched, end = np.zeros(len(first), dtype=np.int64), np.array(size, dtype=np.int64)  # the stretch ends before `end`
        live = np.flatnonzero(size >= self.depth)
        while len(live):
            full = live[matched[live] == self.depth]
            low[full], high[full] = self.shorter(low[full])
            matched[full] -= 1
            end[full] -= 1
            at = end[live] - matched[live] - 1
            symbol = row[first[live] + at]
            known = self.counts[np.minimum(symbol, self.n_symbols - 1)] > 0
            known &= symbol < self.n_symbols
            a, b = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
            a[known], b[known] = self.longer(low[live[known]], high[live[known]], symbol[known])
            hit = a < b
            found, lost = live[hit], live[~hit]
            low[found], high[found] = a[hit], b[hit]
            matched[found] += 1
            low[lost], high[lost], matched[lost] = 0, self.n, 0
            end[lost] -= 1
            full = matched[found] == self.depth
            out[found[full], at[hit][full]] = self.least(low[found[full]])
            # a window must still fit in what is left
            live = live[end[live] - (matched[live] == self.depth) >= self.depth]
        return out
