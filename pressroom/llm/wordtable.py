"""Token ids of whole texts by way of their distinct pieces.

A text is cut in front of a run of blanks that follows something else. Byte-level
and word-level BPE never merge across such a cut, so a text's ids are the ids of its
pieces one after the other. Arrow tells the distinct pieces of a slice of texts apart,
each that this worker has not met yet is encoded once, and the ids of the whole slice
are gathered from one flat table. The table has a bounded number of pieces; when it is
full, those that came up seldom go, which changes the time but not the ids."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import slices

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
#: ASCII characters that some library calls white space, besides blank and line feed.
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ``[ \\n]*[^ \\n]+`` (or a last ``[ \\n]+``) in each text."""
    blank = _BLANK[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & ~blank[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)).astype(np.int64)


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold white space other than blank and line feed: there, cuts
    could fall inside a run of white space."""
    hit = _ODD[data]
    for lead, rest in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80), (0xA0, 0x8E))), (0xE3, ((0x80, 0x80),)), (0xE2, ((0x81, 0x9F), *((0x80, x) for x in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF))))):
        at = np.flatnonzero(data == lead)
        for tail in rest:
            there = at[at + len(tail) < len(data)]
            for k, x in enumerate(tail, 1):
                there = there[data[there + k] == x]
            hit[there] = True
    total = np.concatenate(([0], np.cumsum(hit)))
    return (total[offsets[1:]] - total[offsets[:-1]]) > 0


class WordTable:
    """``encode`` gives the ids of a list of pieces; ``limit`` bounds how many are kept.
    Pieces are told apart by their bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 400_000, strip: bool = False):
        self.encode, self.limit, self.strip = encode, limit, strip
        self.clear()

    def clear(self) -> None:
        self.slot_of: dict[bytes, int] = {}
        self.first, self.count = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.met = np.zeros(1 << 12, np.uint8)
        self.ids, self.used = np.empty(1 << 16, np.int32), 0

    def _thin(self) -> None:
        """Keep the pieces that came up in several slices, at most half of the limit."""
        words, have = list(self.slot_of), len(self.slot_of)
        often = next((n for n in (2, 3, 6, 12, 24, 48) if (self.met[:have] >= n).sum() <= self.limit // 2), None)
        keep = np.flatnonzero(self.met[:have] >= often) if often else np.empty(0, np.int64)
        first, count, ids = self.first[keep], self.count[keep], self.ids
        self.clear()
        stop = np.cumsum(count)
        self.used = int(stop[-1]) if len(stop) else 0
        self.ids = self._room(self.ids, self.used)
        self.ids[: self.used] = ids[np.arange(self.used) + np.repeat(first - stop + count, count)]
        self.first, self.count, self.met = (self._room(x, len(keep)) for x in (self.first, self.count, self.met))
        self.first[: len(keep)], self.count[: len(keep)] = stop - count, count
        self.slot_of.update(zip([words[i] for i in keep.tolist()], range(len(keep))))

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate((array, np.empty(max(size - len(array), len(array)), array.dtype)))

    def _add(self, words: list[bytes]) -> np.ndarray:
        encoded = self.encode([w.decode("utf-8", "replace") for w in words])
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total, have = int(counts.sum()), len(self.slot_of)
        self.ids = self._room(self.ids, self.used + total)
        self.ids[self.used : self.used + total] = np.fromiter((x for e in encoded for x in e), np.int32, total)
        self.first, self.count, self.met = (self._room(x, have + len(words)) for x in (self.first, self.count, self.met))
        self.first[have : have + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[have : have + len(words)] = counts
        self.met[have : have + len(words)] = 0
        self.used += total
        self.slot_of.update(zip(words, range(have, have + len(words))))
        return np.arange(have, have + len(words))

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.strip:  # white space in front has no ids of its own
            blank = _BLANK[data]
            data, kept = data[~blank], np.concatenate(([0], np.cumsum(~blank)))
            starts, ends = kept[starts], kept[ends]
        offsets = np.append(starts, ends[-1:]).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = cut.dictionary.to_pylist()
        if len(self.slot_of) + len(words) > self.limit:
            self._thin()
        slots = np.fromiter(map(self.slot_of.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self._add([words[i] for i in new.tolist()])
        self.met[slots] = np.minimum(self.met[slots], 254) + 1
        return slots[cut.indices.to_numpy(zero_copy_only=False)]

    def texts(self, data: np.ndarray, offsets: np.ndarray, whole: Callable[[str], list[int]] | None = None, most: int = 1_000_000):
        """Yields (i, j, ids, bounds): the ids of texts i to j - 1 and the j - i + 1
        bounds between them. ``whole`` encodes texts that must not be cut."""
        for i, j in slices(offsets, most):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) == 0:
                yield i, j, np.empty(0, np.int32), np.zeros(j - i + 1, np.int64)
                continue
            starts, ends = pieces(part, offs)
            slots = self._slots(part, starts, ends)
            counts, first = self.count[slots], self.first[slots]
            stop = np.cumsum(counts)
            ids = self.ids[np.arange(int(stop[-1])) + np.repeat(first - stop + counts, counts)]
            bounds = np.concatenate(([0], stop))[np.searchsorted(starts, offs)]
            odd = np.flatnonzero(odd_texts(part, offs)) if whole else ()
            if len(odd):
                own = {int(k): np.asarray(whole(part[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")), np.int32) for k in odd}
                rows = [own.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(j - i)]
                ids, bounds = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
            yield i, j, ids, bounds
