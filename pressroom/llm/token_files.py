"""Token ids in binary files made of independent zstandard frames.

File layout (little endian): one zstandard frame per document holding its ids as
unsigned integers of ``width`` bytes, each with zstandard's own content checksum; a
skippable frame with the documents' keys; last, the seek table of the zstandard
seekable format, a skippable frame with one (compressed size, size, low 32 bits of
XXH64) entry per frame. A reader takes the table from the end of the file and then
reads and decompresses only the frames of the documents it wants."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, input_partitions, scratch, string_bytes
from .wordtable import WordTable

# Fixed values of the zstandard seekable format.
_KEYS_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NO_KEY = -(1 << 63)
_tables: dict[str, tuple] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}


def id_width(path: str, extra: int, width: int | None = None) -> int:
    """Bytes of an id: by default the least of 2 and 4 that holds all ids of the file and
    ``extra``; a given width must hold them too."""
    with open(path, encoding="utf-8") as f:
        top = max([extra, *json.load(f)["model"]["vocab"].values(), *added_tokens(path).values()])
    least = 2 if top < 1 << 16 else 4
    if width is not None and (width not in (2, 4) or width < least):
        raise ValueError(f"{width} bytes do not hold id {top}")
    return width or least


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def byte_table(path: str) -> tuple[WordTable, object]:
    """One table per worker process, kept from task to task."""
    if path not in _tables:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tables[path] = (WordTable(lambda words: [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)], limit=1_000_000), lambda text: t.encode(text, add_special_tokens=False).ids)
    return _tables[path]


class FrameWriter:
    """Streams frames to ``sink`` and remembers 20 bytes for each of them."""

    def __init__(self, sink, width: int, level: int = 1):
        import zstandard

        self.sink, self.width = sink, width
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table, self.keys = [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype(f"<u{self.width}").tobytes()
        packed = self.compressor.compress(raw)
        self.sink.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.keys.append(_NO_KEY if key is None else key)

    def close(self) -> None:
        keys = struct.pack("<B", self.width) + np.asarray(self.keys, "<i8").tobytes()
        self.sink.write(struct.pack("<II", _KEYS_MAGIC, len(keys)) + keys)
        table = b"".join(self.table)
        self.sink.write(struct.pack("<II", _SEEK_MAGIC, len(table) + 9) + table)
        self.sink.write(struct.pack("<IBI", len(self.table), 0x80, _FOOTER_MAGIC))
        self.sink.close()


class FrameReader:
    """Random access to the documents of one file; every frame read is checked
    against its checksum."""

    def __init__(self, path: str):
        import zstandard

        store, inner = filesystem(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, self.size - 9))
        if magic != _FOOTER_MAGIC:
            raise ValueError(f"{path}: no seek table")
        step = 12 if flags & 0x80 else 8
        length = 8 + n * step + 9
        magic, size = struct.unpack("<II", self.file.read_at(8, self.size - length))
        if magic != _SEEK_MAGIC or size != n * step + 9:
            raise ValueError(f"{path}: damaged seek table")
        self.table = np.frombuffer(self.file.read_at(n * step, self.size - length + 8), "<u4").reshape(n, step // 4)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        at = int(self.starts[-1])
        magic, size = struct.unpack("<II", self.file.read_at(8, at))
        if magic != _KEYS_MAGIC:
            raise ValueError(f"{path}: no keys")
        body = self.file.read_at(size, at + 8)
        self.width, self.keys = body[0], np.frombuffer(body[1:], "<i8")
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def read(self, first: int, stop: int | None = None, most: int = 8 << 20) -> Iterator[np.ndarray]:
        """Ids of documents first to stop - 1, reading the file in bounded pieces."""
        import xxhash

        stop = first + 1 if stop is None else stop
        while first < stop:
            last = int(np.searchsorted(self.starts, self.starts[first] + most, side="right")) - 1
            last = min(max(last, first + 1), stop)
            base = int(self.starts[first])
            block = memoryview(self.file.read_at(int(self.starts[last]) - base, base))
            for k in range(first, last):
                raw = self.decompressor.decompress(block[int(self.starts[k]) - base : int(self.starts[k + 1]) - base])
                if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                    raise ValueError(f"frame {k} fails its checksum")
                yield np.frombuffer(raw, f"<u{self.width}")
            first = last


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int | None = None, partitions: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write one file per key range, ids ascending by ``key``.

    Returns the manifest (part, path, n_docs, n_tokens). A retried task writes a file
    of another name; only files named in the manifest count. Null and empty texts are
    frames with the end id alone; null keys come first; equal keys stay in any
    order; an empty table gives an empty manifest; other columns are not read.
    ``width`` 2 or 4 bytes, by default the least that fits the vocabulary."""
    width = id_width(tokenizer, end_id, width)

    def run(batches):
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        out, total = None, 0
        table, whole = byte_table(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, inner = filesystem(path)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                out = FrameWriter(store.open_output_stream(inner, compression=None), width)
            keys = batch.column(0).to_pylist()
            data, offsets = string_bytes(batch.column(1))
            for i, j, ids, bounds in table.texts(data, offsets, whole):
                for k in range(i, j):
                    own = np.append(ids[bounds[k - i] : bounds[k - i + 1]], np.int32(end_id))
                    out.add(keys[k], own)
                    total += len(own)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([len(out.table)], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    n = partitions or input_partitions(docs)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    dealt = rows.repartitionByRange(n, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first())
    return dealt.mapInArrow(run, "part long, path string, n_docs long, n_tokens long")


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files: part, ordinal in its file, doc_id, n_tokens and the
    CRC-32 of its ids as little-endian unsigned 32-bit integers, plus start: ids of all
    documents before it in the whole collection."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before)

    def run(batches):
        for batch in batches:
            for part, path, base in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "base"))):
                reader = FrameReader(path)
                at, first = base, 0
                while first < len(reader):
                    stop = min(first + 8192, len(reader))
                    counts, crcs = [], []
                    for ids in reader.read(first, stop):
                        counts.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    size = np.asarray(counts, np.int64)
                    keys = reader.keys[first:stop]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64(), mask=keys == _NO_KEY), pa.array(at + np.cumsum(size) - size), pa.array(size), pa.array(crcs, pa.int64()), pa.array([part] * len(size), pa.int64()), pa.array(np.arange(first, stop))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "part", "ordinal"],
                    )
                    at, first = at + int(size.sum()), stop

    n = max(1, input_partitions(manifest))
    return files.repartitionByRange(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part long, ordinal long")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    path = tokenizer or default_path("byte_bpe_50k.json")
    manifest = as_table(write(docs, scratch(spark, "ids"), path, end_id), "ids-manifest")
    return read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
