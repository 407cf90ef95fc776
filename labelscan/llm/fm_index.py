"""A compressed FM-index over short pieces of words, searched for many pieces in step."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols as bit planes, each packed into 64-bit words with a running count of ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        n = len(symbols)
        order = symbols.astype(np.int64)
        ids = np.arange(size)
        first = np.zeros(size, np.int64)  # where each symbol's run begins below the last plane
        for level in range(self.levels - 1, -1, -1):
            bit = (order >> level) & 1
            padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1]
            zeros = n - int(bit.sum())
            self.planes.append((words, counts, zeros))
            order = np.concatenate((order[bit == 0], order[bit == 1]))
            first = self._down(len(self.planes) - 1, first, (ids >> level) & 1)
        self.first = first

    def _down(self, plane: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        words, counts, zeros = self.planes[plane]
        block = at >> 6
        ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(bit == 1, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for plane in range(self.levels):
            at = self._down(plane, at, (symbol >> (self.levels - 1 - plane)) & 1)
        return at - self.first[symbol]


class FMIndex:
    """Index of pieces, given as one array of word hashes and the pieces' lengths, each with an owner (a number).

    `window` is the length above which matches count. Suffixes are sorted by doubling; a sentinel of its own ends each
    piece, so that no match crosses pieces and the doubling ends at the longest piece.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int):
        m = len(lengths)
        _, ids = np.unique(hashes, return_inverse=True)
        self.size = int(ids.max(initial=-1)) + 2
        self.window, self.lengths = window, lengths
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        n = len(hashes) + m
        words = np.ones(n, bool)
        words[ends] = False
        rank = np.empty(n, np.int64)
        rank[ends] = np.arange(m)
        rank[words] = ids + m
        self.text = np.zeros(n, np.int64)  # 0 is any sentinel
        self.text[words] = ids + 1
        owner = np.repeat(owners, lengths + 1)
        depth, half = 1, None
        while True:
            if depth * 2 > window and half is None:  # equal in the first `depth` words, which are at least half of the window
                half = (depth, rank)
            ahead = np.zeros(n, np.int64)
            ahead[:-depth] = rank[depth:] + 1
            _, new = np.unique(rank * (n + 1) + ahead, return_inverse=True)
            if half is not None and int(new.max()) == n - 1:
                rank = new
                break
            rank, depth = new, depth * 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        before = self.text[suffixes - 1]
        self.matrix = WaveletMatrix(before, self.size)
        counts = np.bincount(self.text, minlength=self.size)
        self.smaller = np.cumsum(counts) - counts
        # classes of suffixes that agree in the window: two overlapping stretches of half's depth cover it
        reach, same = half
        shifted = np.zeros(n, np.int64)
        shifted[: n - (window - reach)] = same[window - reach :]
        a, b = same[suffixes], shifted[suffixes]
        new_class = np.ones(n, bool)
        new_class[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new_class)
        number = np.cumsum(new_class) - 1
        self.class_start, self.class_end = first[number], np.append(first[1:], n)[number]
        self.class_owner = np.minimum.reduceat(owner[suffixes], first)[number]

    def owners(self) -> np.ndarray:
        """Smallest owner of each window of each piece: pieces by windows, -1 beyond a piece's windows.

        All pieces are streamed backwards in step. Each word extends a piece's match by one step of backward search;
        a match longer than the window is shortened to it, which widens its interval to the window's class. The
        matching statistic of a position being at least the window, its interval's smallest owner is reported.
        """
        out = np.full((len(self.lengths), max(1, int(self.lengths.max(initial=0)) - self.window + 1)), -1, np.int64)
        low, high = np.zeros(len(self.lengths), np.int64), np.full(len(self.lengths), len(self.text))
        for step in range(int(self.lengths.max(initial=0))):
            live = np.flatnonzero(self.lengths > step)
            at = self.lengths[live] - 1 - step
            word = self.text[self.starts[live] + at]
            a = self.smaller[word] + self.matrix.rank(word, low[live])
            if step + 1 >= self.window:  # the lower end alone tells the class, and so the upper end
                out[live, at] = self.class_owner[a]
                a, b = self.class_start[a], self.class_end[a]
            else:
                b = self.smaller[word] + self.matrix.rank(word, high[live])
            low[live], high[live] = a, b
        return out
