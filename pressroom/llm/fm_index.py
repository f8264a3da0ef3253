"""A compressed FM-index over a sequence of word numbers, searched in batches.

The Burrows-Wheeler transform is kept as a wavelet matrix: one bit vector per bit of
the word numbers, packed into 64-bit words with running counts. All queries of a
batch take each backward step together."""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32)
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of one number k, from 0."""
        w = np.searchsorted(self.before, k, side="right") - 1
        need, word, at = k - self.before[w], self.words[w], np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word >> at & np.uint64((1 << step) - 1))
            over = low <= need
            need = need - np.where(over, low, 0)
            at += np.where(over, np.uint64(step), np.uint64(0))
        return w * 64 + at.astype(np.int64)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            self.levels.append((bit, BitVector(ones)))
            values = np.concatenate((values[ones == 0], values[ones == 1]))
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, level in self.levels:
            ones = level.rank(i).astype(np.int64)
            i = np.where((symbol >> bit) & 1, level.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that ``symbol`` stands before position i."""
        return self._down(symbol, i) - self.first[symbol]


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ranked = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
    return out


class FMIndex:
    """Index of ``text`` (numbers from 0 up) for patterns of at most ``depth`` words.

    Suffixes are sorted by prefix doubling until twice the depth is covered, which is
    all that patterns of that length can tell apart. Kept are the wavelet matrix, one
    bit per suffix for where a new group of equal first depth - 1 words begins, and one
    byte per suffix for how many places it stands for (``weights``, up to ``least``)."""

    def __init__(self, text: np.ndarray, depth: int, weights: np.ndarray, least: int = 2):
        n = len(text)
        self.depth, self.least, self.size = depth, least, n
        ranks, width = {1: text.astype(np.int64)}, 1

        def later(r: np.ndarray, d: int) -> np.ndarray:
            return np.concatenate((r[d:] + 1, np.zeros(min(d, n), np.int64)))[:n]

        while width < depth:
            r = ranks[width]
            ranks[2 * width] = _dense(r * (n + 1) + later(r, width))
            width *= 2
        order = np.argsort(ranks[width], kind="stable")
        # Where two neighbours differ within the first depth - 1 words.
        differ, at = np.zeros(n, bool), 0
        for size in sorted(ranks, reverse=True):
            while depth - 1 - at >= size:
                part = later(ranks[size], at)[order] if at else ranks[size][order]
                differ[1:] |= part[1:] != part[:-1]
                at += size
        del ranks
        differ[0] = True
        self.heads = BitVector(np.append(differ, True).astype(np.uint8))
        symbols = int(text.max()) + 1 if n else 1
        counts = np.bincount(text, minlength=symbols)
        self.starts = np.cumsum(counts) - counts
        self.weight = np.append(np.minimum(weights[order], min(least, 255)), 0).astype(np.uint8)
        self.wavelet = WaveletMatrix(text[order - 1], symbols)

    def _often(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the suffixes from lo to hi - 1, all within texts, stand for ``least``
        places: as many suffixes do, and of fewer the weights are added up."""
        often = hi - lo >= self.least
        few = np.flatnonzero(~often & (hi > lo))
        total = np.zeros(len(few), np.int64)
        for k in range(self.least - 1):
            at = lo[few] + k
            total += np.where(at < hi[few], self.weight[np.minimum(at, self.size)], 0)
        often[few] = total >= self.least
        return often

    def windows(self, text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Matching statistics of the segments text[first : first + length], capped at
        ``depth`` and read from right to left: for each position, whether the ``depth``
        words that start there stand at ``least`` places; false where fewer are left.

        The state of a segment is the interval of its current match; at full depth the
        match gives up its last word (its interval grows to that of the shorter match)
        before it takes the next word in front."""
        out = np.zeros(len(text), bool)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), self.size, np.int64)
        for step in range(int(length.max()) if len(length) else 0):
            live = int(np.searchsorted(-length, -step, side="left"))
            at = first[:live] + length[:live] - 1 - step
            if step >= self.depth:
                group = self.heads.rank(lo[:live] + 1).astype(np.int64)
                lo[:live], hi[:live] = self.heads.select(group - 1), self.heads.select(group)
            word = text[at]
            both = self.wavelet.rank(np.concatenate((word, word)), np.concatenate((lo[:live], hi[:live])))
            lo[:live], hi[:live] = self.starts[word] + both[:live], self.starts[word] + both[live:]
            if step >= self.depth - 1:
                out[at] = self._often(lo[:live], hi[:live])
        return out
