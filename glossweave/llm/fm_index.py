"""A compressed FM-index over word sequences: Burrows-Wheeler transform, wavelet matrix, batched backward search.

The transform takes as many bits a word as the shard's vocabulary needs, and 1/8 more for ranks.
Rows that agree on a whole window are marked by a bit vector, with one number for each such class.
The words themselves are kept while the segments are streamed through the index.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n >> 6) + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        self.before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Symbols below ``size`` stored bit by bit; answers how often a symbol stands before a place."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.origin = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            r = vector.rank(i)
            i = np.where(symbol >> bit & 1, zeros + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(symbol, i) - self.origin[symbol]


class FMIndex:
    """An index of segments for windows of up to ``window`` words.

    Suffixes are sorted by at least ``window + 1`` words, which is all that
    backward search for that many words relies on.  ``weights`` says how often
    each segment occurs in the collection.
    """

    def __init__(self, segments: np.ndarray, first: np.ndarray, weights: np.ndarray, window: int):
        self.window = window
        _, coded = np.unique(segments, return_inverse=True)
        n = len(first) - 1
        # every segment is followed by the separator 0
        self.text = np.zeros(len(segments) + n, np.int64)
        self.owner = np.repeat(np.arange(n), np.diff(first) + 1)
        self.begin = first[:-1] + np.arange(n)
        inside = np.ones(len(self.text), bool)
        inside[first[1:] + np.arange(n)] = False
        self.text[inside] = coded + 1
        size = int(self.text.max(initial=0)) + 1
        rank, depth, at_window = self.text, 1, None
        while depth <= window:
            if depth * 2 > window and at_window is None:
                at_window = (rank, depth)  # the deepest order within a window
            rank = self._doubled(rank, depth)
            depth *= 2
        order = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(self.text[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=size))])
        # rows that agree on a whole window are one class
        r, d = at_window
        r = np.concatenate([r, np.zeros(window, np.int64)])
        a, b = r[order], r[order + window - d]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.new = BitVector(new[:-1])
        self.edges = np.flatnonzero(new)
        total = np.concatenate([[0], np.cumsum(weights[self.owner[order]])])[self.edges]
        self.mass = np.diff(total)

    @staticmethod
    def _doubled(rank: np.ndarray, h: int) -> np.ndarray:
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - h)] = rank[h:]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        up = np.zeros(len(k), np.int64)
        up[1:] = k[1:] != k[:-1]
        out = np.empty_like(rank)
        out[order] = np.cumsum(up)
        return out

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: rows whose suffix begins with the word and then what it began with."""
        base = self.smaller[word]
        return base + self.bwt.rank(word, lo), base + self.bwt.rank(word, hi)

    def repeated_windows(self, piece: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(segment, offset) of every window that occurs twice or more, by matching statistics of the segments.

        Segments are streamed right to left, long ones in pieces, all at once.
        A match longer than a window is cut back to the class of its first
        ``window`` words, so each word costs one step.
        """
        n = np.diff(np.concatenate([self.begin, [len(self.text)]])) - 1
        windows = n - self.window + 1
        pieces = -(-np.maximum(windows, 0) // piece)
        segment = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(segment)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
        stop = np.minimum(start + piece, windows[segment]) + self.window - 1  # of the words, exclusive
        lo, hi = np.zeros(len(segment), np.int64), np.full(len(segment), len(self.text), np.int64)
        length = np.zeros(len(segment), np.int64)
        at = stop.copy()
        active = np.arange(len(segment))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            at[active] -= 1
            word = self.text[self.begin[segment[active]] + at[active]]
            a, b = self.extend(word, lo[active], hi[active])
            m = length[active] + 1
            long = m > self.window
            # a match of a whole window is a class of rows
            which = self.new.rank(np.minimum(a, len(self.text) - 1) + 1) - 1
            a, b = np.where(long, self.edges[which], a), np.where(long, self.edges[which + 1], b)
            m = np.minimum(m, self.window)
            lo[active], hi[active], length[active] = a, b, m
            hit = (m == self.window) & (self.mass[which] >= 2)
            found.append((segment[active[hit]], at[active[hit]]))
            active = active[at[active] > start[active]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
