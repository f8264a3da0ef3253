"""Vector codes by product quantisation, all in whole numbers.

Vectors are cut into equal parts, and each part position has a codebook that is refined
in rounds. What is compared with a codebook are distinct parts in lexicographic order, a
trie whose nodes are their common prefixes: a walk through it, one run of leaves after
the other, keeps the distances of each prefix to the same prefix of every entry, so that
parts share what their prefixes share; at a leaf they are the whole distances, and the
least names the entry. Distinct parts carry how often they occur, so copies cost nothing
in the rounds. Only codebooks and their sums, which do not grow with the rows, pass
through the driver."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_table, input_partitions

#: Components beyond this in size have squares whose sums could overflow.
_MOST = 1 << 27


def walk(parts: np.ndarray, book: np.ndarray, leaves: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equals) and squared distance of each of the parts,
    which are distinct and in lexicographic order."""
    n, width = parts.shape
    code, far = np.empty(n, np.int64), np.empty(n, np.int64)
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Doubles hold whole numbers below 2**53 exactly, and are added faster.
    kind = np.float64 if 4 * width * most * most < 1 << 53 else np.int64
    entries = np.ascontiguousarray(book.T.astype(kind))
    differ = parts[1:] != parts[:-1]
    fork = np.concatenate(([0], differ.argmax(1) if n > 1 else [])).astype(np.int64)  # depth at which a part leaves the one before
    for i in range(0, n, leaves):
        own, depth = parts[i : i + leaves].astype(kind), fork[i : i + leaves].copy()
        depth[:1] = 0
        node, total = np.zeros(1, np.int64), np.zeros((1, len(book)), kind)
        for k in range(width):
            below = np.flatnonzero(depth <= k)  # first leaves of the nodes one deeper
            if len(below) > len(node):
                total = total[np.searchsorted(node, below, side="right") - 1]
            node = below
            step = own[below, k, None] - entries[k]
            step *= step
            total += step
        at = total.argmin(1)
        code[i : i + leaves], far[i : i + leaves] = at, total[np.arange(len(at)), at]
    return code, far


def _lexicographic(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the place of every row among them."""
    order = np.lexsort(parts.T[::-1])
    line = parts[order]
    new = np.concatenate(([True], (line[1:] != line[:-1]).any(1))) if len(line) else np.empty(0, bool)
    where = np.empty(len(parts), np.int64)
    where[order] = np.cumsum(new) - 1
    return line[new], where


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def train(vectors: DataFrame, first: list[list[int]], parts: int, rounds: int) -> np.ndarray:
    """Codebooks (part position, entry, component) after some rounds over ``vectors``
    (x: whole numbers, all of one length), from the vectors ``first``."""
    spark, books = vectors.sparkSession, np.asarray(first, np.int64)
    width = books.shape[1] // parts
    books = books.reshape(len(first), parts, width).swapaxes(0, 1).copy()
    cut = vectors.select(F.posexplode(F.array(*[F.slice("x", p * width + 1, width) for p in range(parts)])).alias("pos", "part"))
    distinct = as_table(cut.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    ordered = as_table(distinct.repartitionByRange(input_partitions(vectors), "pos", "part").sortWithinPartitions("pos", "part"), "parts-in-order")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def assign(batches):
            book = shared.value
            sums, count = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
            for batch in batches:
                pos, rows, n = batch.column(0).to_numpy(), _matrix(batch.column(1), width), batch.column(2).to_numpy()
                for p in np.unique(pos).tolist():
                    at = np.flatnonzero(pos == p)
                    code, _ = walk(rows[at], book[p])
                    np.add.at(sums[p], code, rows[at] * n[at, None])
                    np.add.at(count[p], code, n[at])
            p, e = np.nonzero(count)
            flat = sums[p, e].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width).astype(np.int32)), pa.array(np.repeat(e, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), pa.array(flat), pa.array(np.repeat(count[p, e], width))], ["pos", "entry", "at", "total", "n"])

        sums = ordered.mapInArrow(assign, "pos int, entry int, at int, total long, n long").groupBy("pos", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():  # a row for each component of the codebooks
            books[r["pos"], r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def encode(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """vec_id, code (``parts`` indexes of two hex digits), error (squared distance from
    the entries), label_error (error summed over the rows of one label, nulls together)
    and codebooks_sha256.

    Vectors are taken as floor(scale * x). Rows whose vector is null, empty or holds null
    or non-finite components take no part, nor do those whose scaled components reach
    2**27 in size, or whose length does not divide by ``parts`` or is not that of the kept
    vector with the least id (null ids behind all others, equal ids by the vector). With
    fewer than ``entries`` vectors there are as many entries. Rows that repeat an id are
    rows of their own. Columns of other names are left out."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = rows.sparkSession
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < _MOST))
    good = rows.filter(sound).select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *[T.StructField(c, t) for c, t in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))]])
    least = good.orderBy(*order).limit(1).collect()
    if not least:
        return spark.createDataFrame([], schema)
    size = len(least[0]["x"])
    good = as_table(good.filter(F.size("x") == size), "code-vectors")
    first = [r["x"] for r in good.orderBy(*order).limit(entries).collect()]
    books = train(good.select("x"), first, parts, rounds)
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared, width = spark.sparkContext.broadcast(books), size // parts

    def code(batches):
        for batch in batches:
            x = _matrix(batch.column(2), size)
            digits, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                own, where = _lexicographic(x[:, p * width : (p + 1) * width])
                at, far = walk(own, shared.value[p])
                digits[:, p] = at[where]
                error += far[where]
            text = [bytes(d).hex() for d in digits.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kinds = T.StructType([*good.select("id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = as_table(good.mapInArrow(code, kinds), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
