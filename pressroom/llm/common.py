"""Helpers shared by the corpus operators: scratch tables in the shared folder,
access to the bytes behind Arrow string columns, and vectorised hashing of words."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import drop_folder, shared_folder


#: The open scopes of working tables, innermost last; each thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("working_tables", default=())


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share. Inside
    ``working_tables`` the folder is dropped at the end, unless ``keep``."""
    path = shared_folder(spark, name)
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return path


def as_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here,
    so a lost executor costs no recomputation of what came before. A working table
    unless ``keep``, as for ``scratch``."""
    path = scratch(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def working_tables(spark: SparkSession):
    """Tables that are written inside, and not kept, are deleted on the way out."""
    own: list[str] = []
    mark = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(mark)
        for path in own:
            drop_folder(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- Arrow strings
def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its values; a
    null is an empty value."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int, rows: int | None = None):
    """Runs (i, j) of values with at most ``most`` bytes together (a longer value
    is a run of its own) and at most ``rows`` values, so that temporaries stay small
    whatever the batch."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n, n if rows is None else i + rows)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, eight of them at a time, each block
    through ``mix``, so that no pattern of bytes cancels out. Spans of more than 512
    bytes, of which there cannot be many, go through xxHash one by one."""
    import xxhash

    length = ends - starts
    h = mix(length.astype(np.uint64) * _SPREAD + np.uint64((2 * seed + 1) << 40))
    if not len(h):
        return h
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, at = np.flatnonzero(length <= _LONG), 0
    while len(live):
        rest = length[live] - at
        value = blocks[starts[live] + at]
        value &= ~np.uint64(0) >> (np.uint64(8) * np.uint64(8) - np.uint64(8) * np.clip(rest, 1, 8).astype(np.uint64))
        h[live] = mix(h[live] ^ value)
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed))
    return h


class Runs:
    """Hashes of runs of consecutive words, from the hashes of the words. A run of n
    words is made of its first and its last 2**k words, 2**k <= n < 2**(k + 1), and
    those in the same way of halves, with ``mix`` in each step."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    @staticmethod
    def _join(a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        return mix(a * _LEFT + (b ^ (b >> np.uint64(32))) * _RIGHT + np.asarray(n, np.uint64) * _SPREAD)

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, low = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(self._join(low[:-half], low[half:], 2 * half) if len(low) > half else low[:0])
        return self.levels[k]

    def hashes(self, starts: np.ndarray, lengths) -> np.ndarray:
        """Hashes of the runs of ``lengths`` words (one number or one for each)."""
        lengths = np.broadcast_to(lengths, starts.shape)
        out = np.empty(len(starts), np.uint64)
        top = np.frexp(lengths.astype(np.float64))[1] - 1
        for k in np.unique(top).tolist():
            at = slice(None) if len(starts) and (top == k).all() else np.flatnonzero(top == k)
            level, first, n = self._level(k), starts[at], lengths[at]
            out[at] = self._join(level[first], level[first + n - (1 << k)], n)
        return out


# ---------------------------------------------------------------- words
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes that are not ``between``
    words: ``[^\\x20\\x09-\\x0D]+`` unless told otherwise."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~between[data]
    first = np.zeros(n, bool)
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = True
    starts_mask = inside.copy()
    starts_mask[1:] &= ~inside[:-1] | first[1:]
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(starts_mask)
    ends = np.flatnonzero(ends_mask) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: np.ndarray = _SPACE) -> pa.DictionaryArray:
    """The words that ``word_spans`` found, told apart by their bytes."""
    packed = np.ascontiguousarray(data[~between[data]])
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words.dictionary_encode()


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 0 up for the words ``word_spans`` found: two words have one number
    exactly where their bytes are equal."""
    return distinct_words(data, starts, ends).indices.to_numpy(zero_copy_only=False).astype(np.int64)
