"""Documents of flat token files, found by scanning for the end-of-document id.

A flat file is nothing but ids of 2 or 4 bytes; each document ends with the
separator id. Blocks of a file are scanned independently with one vectorised
comparison. What a block cannot know - how many documents end before it and where
the document that is open at its first id began - comes from a prefix scan over the
blocks of each file."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import word_table
from .common import as_table, input_partitions, scratch, string_bytes
from .token_files import added_tokens, default_path, filesystem, id_width


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of each partition to one flat file, a separator after each
    document, and return (path, n_bytes, ordinal, doc_id). Strings of special tokens
    are encoded as ordinary text, so a separator is always an end of document."""

    def run(batches):
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        sink, size, keys = None, 0, []
        table = word_table(tokenizer, False)
        end = np.asarray([separator], f"<u{width}").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                store, inner = filesystem(path)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(inner, compression=None)
            keys.append(batch.column(0))
            data, offsets = string_bytes(batch.column(1))
            for i, j, ids, bounds in table.texts(data, offsets):
                raw = ids.astype(f"<u{width}").tobytes()
                out = b"".join(x for k in range(j - i) for x in (raw[bounds[k] * width : bounds[k + 1] * width], end))
                sink.write(out)
                size += len(out)
        if sink is not None:
            sink.close()
            done = 0
            for k in keys:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(k)), pa.array([size] * len(k), pa.int64()), pa.array(np.arange(done, done + len(k))), k], ["path", "n_bytes", "ordinal", "doc_id"])
                done += len(k)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "path string, n_bytes long, ordinal long, doc_id long")


def scan(files: DataFrame, separator: int, width: int, block_bytes: int = 4 << 20) -> DataFrame:
    """(path, ordinal, start, n_tokens, terminated) of every document in ``files``
    (path, n_bytes). start counts ids from the start of the file; n_tokens leaves the
    separator out. Ids after the last separator are a document with terminated =
    false; an empty file has none. A document may span any number of blocks."""
    block = block_bytes // width * width
    blocks = files.filter("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block))).alias("block"))

    def run(batches):
        for batch in batches:
            for path, size, b in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "block"))):
                store, inner = filesystem(path)
                with store.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(min(block, size - b * block) // width * width, b * block), f"<u{width}")
                found = np.flatnonzero(ids == separator).astype(np.int64) + b * (block // width)
                n = len(found)
                if n:
                    before = np.concatenate(([-1], found[:-1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array([b] * n, pa.int64()), pa.array(np.arange(n)), pa.array(found), pa.array(before, pa.int64(), mask=np.arange(n) == 0)],
                        ["path", "block", "k", "pos", "prev"],
                    )

    n = input_partitions(files)
    ends = as_table(blocks.repartition(n, "path", "block").mapInArrow(run, "path string, block long, k long, pos long, prev long"), "separators")
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.groupBy("path", "block").agg(F.count("*").alias("n"), F.max("pos").alias("last")).select("path", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(order), F.lit(-1)).alias("open"))
    start = F.coalesce(F.col("prev"), F.col("open")) + 1
    closed = ends.join(carry, ["path", "block"]).select("path", (F.col("before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("pos") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = ends.groupBy("path").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    total = F.floor(F.col("n_bytes") / width)
    first = F.coalesce(F.col("last"), F.lit(-1)) + 1
    rest = files.join(tails, "path", "left").filter(total > first).select("path", F.coalesce(F.col("n"), F.lit(0)).alias("ordinal"), first.alias("start"), (total - first).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(rest)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, separator: int | None = None, width: int | None = None, end: str = "<|endoftext|>") -> DataFrame:
    """Write ``docs`` as flat files and count by scanning them: doc_id, n_tokens.

    The separator is the id of the added token ``end`` in the tokenizer's file, the width
    the least of 2 and 4 bytes that holds all its ids, unless they are given; a width
    that does not hold them is an error. Null and empty texts count 0; repeated rows are
    counted each; extra columns are not read."""
    path = tokenizer or default_path("word_bpe_49k.json")
    if separator is None:
        separator = added_tokens(path)[end]
    width = id_width(path, separator, width)
    listed = as_table(write_flat(docs, scratch(docs.sparkSession, "flat"), path, separator, width), "flat-contents")
    files = listed.groupBy("path").agg(F.max("n_bytes").alias("n_bytes"))
    return scan(files, separator, width).join(listed, ["path", "ordinal"]).select("doc_id", "n_tokens")
