"""Exact ranked lexical search by two hierarchies.

Documents become sparse vectors of term impacts over the terms of a block of items. In a
task, blocks of documents and the items are each put into a hierarchy: like vectors side
by side, a node with the greatest value of each coordinate below it. The sum of products
of two nodes' maxima bounds every score below them, so a pair of nodes whose bound stays
below the kth score of each of the node's items is dropped with all its pairs. A first
pass over a part of the documents gives every item a floor to start from."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, distinct_words, slices, string_bytes, word_spans
from .lyndon import spread

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: An id that stands for null, behind all others.
_NO_ID = np.iinfo(np.int64).max


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts, only A-Z lower-cased, and the text of each."""
    data = _LOWER[data]
    starts, ends, owner = word_spans(data, offsets, _BETWEEN)
    return distinct_words(data, starts, ends, _BETWEEN), owner


class Sparse:
    """Rows of (term, value) pairs: row i is ``ptr[i]:ptr[i + 1]``."""

    __slots__ = ("ptr", "term", "value")

    def __init__(self, ptr: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.ptr, self.term, self.value = ptr, term, value

    def take(self, rows: np.ndarray) -> "Sparse":
        length = np.diff(self.ptr)[rows]
        at, _ = spread(self.ptr[rows], length)
        return Sparse(np.concatenate(([0], np.cumsum(length))), self.term[at], self.value[at])

    def maxima(self, fan: int) -> "Sparse":
        """Rows ``fan`` at a time, with the greatest value of each term."""
        n = len(self.ptr) - 1
        row = np.repeat(np.arange(n), np.diff(self.ptr)) // fan
        order = np.lexsort((self.term, row))
        row, term, value = row[order], self.term[order], self.value[order]
        groups = -(-n // fan)
        if not len(row):
            return Sparse(np.zeros(groups + 1, np.int64), term, value)
        head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1]))))
        return Sparse(np.searchsorted(row[head], np.arange(groups + 1)), term[head], np.maximum.reduceat(value, head))

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner product of each of the rows with ``dense``."""
        length = np.diff(self.ptr)[rows]
        at, _ = spread(self.ptr[rows], length)
        total = np.concatenate(([0], np.cumsum(dense[self.term[at]] * self.value[at])))
        stop = np.cumsum(length)
        return total[stop] - total[stop - length]

    def by_heaviest(self, weight: np.ndarray) -> np.ndarray:
        """An order of the rows that puts those with one heaviest term together."""
        row = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        heavy = weight[self.term] * self.value
        order = np.lexsort((-heavy, row))
        lead = np.full((2, len(self.ptr) - 1), -1)
        length = np.diff(self.ptr)
        for k in (0, 1):
            have = np.flatnonzero(length > k)
            lead[k, have] = self.term[order[self.ptr[have] + k]]
        return np.lexsort((lead[1], lead[0]))


class Hierarchy:
    """``levels[0]`` are groups of rows, each level above joins ``fan`` nodes of the one
    below; ``order`` is the row behind each position."""

    def __init__(self, rows: Sparse, weight: np.ndarray, leaf: int, fan: int):
        self.order, self.leaf, self.fan = rows.by_heaviest(weight), leaf, fan
        self.rows = rows.take(self.order)
        self.levels = [self.rows.maxima(leaf)]
        while len(self.levels[-1].ptr) > 2:
            self.levels.append(self.levels[-1].maxima(fan))

    def below(self, nodes: np.ndarray, level: int) -> np.ndarray:
        """The nodes one level down (of level 0: the positions of rows)."""
        fan = self.fan if level else self.leaf
        most = len((self.levels[level - 1] if level else self.rows).ptr) - 1
        return spread(nodes * fan, np.minimum(fan, most - nodes * fan))[0]


class Search:
    """Items (sparse counts) against blocks of documents, with each item's best so far."""

    def __init__(self, items: Sparse, weight: np.ndarray, floor: np.ndarray, k: int):
        self.k, self.weight = k, weight
        self.tree = Hierarchy(Sparse(items.ptr, items.term, items.value * weight[items.term]), np.ones(len(weight), np.int64), 8, 4)
        self.floor = np.maximum(floor, 1)[self.tree.order]  # the least score that can still matter
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.floor]
        self.dense = np.zeros(len(weight), np.int64)

    def _least(self, level: int, node: int) -> int:
        width = self.tree.leaf * self.tree.fan**level
        return int(self.floor[node * width : (node + 1) * width].min())

    def add(self, docs: Sparse, ids: np.ndarray) -> None:
        if not len(ids) or not len(self.floor):
            return
        self.docs = Hierarchy(docs, self.weight, 16, 8)
        self.ids = ids[self.docs.order]
        top = len(self.docs.levels) - 1
        self._visit(len(self.tree.levels) - 1, 0, top, np.zeros(1, np.int64))

    def _visit(self, i: int, node: int, d: int, nodes: np.ndarray) -> None:
        """One node of items against some nodes of documents."""
        own = self.tree.levels[i]
        span = slice(own.ptr[node], own.ptr[node + 1])
        self.dense[own.term[span]] = own.value[span]
        bound = self.docs.levels[d].products(nodes, self.dense)
        self.dense[own.term[span]] = 0
        keep = np.flatnonzero(bound >= self._least(i, node))
        if not len(keep):
            return
        if d and d >= i:
            self._visit(i, node, d - 1, self.docs.below(nodes[keep], d))
        elif i:
            for child in self.tree.below(np.array([node]), i).tolist():
                self._visit(i - 1, child, d, nodes[keep])
        elif d:
            self._visit(i, node, d - 1, self.docs.below(nodes[keep], d))
        else:
            keep = keep[np.argsort(-bound[keep], kind="stable")]  # the most promising first
            for at in range(0, len(keep), 64):
                part = keep[at : at + 64]
                part = part[bound[part] >= self._least(0, node)]
                if not len(part):
                    return
                self._score(node, self.docs.below(nodes[part], 0))

    def _score(self, node: int, docs: np.ndarray) -> None:
        own = self.tree.levels[0]
        term = own.term[own.ptr[node] : own.ptr[node + 1]]
        items = self.tree.below(np.array([node]), 0)
        value = np.zeros((len(term) + 1, len(items)), np.int64)
        self.dense[term] = np.arange(1, len(term) + 1)
        for j, q in enumerate(items.tolist()):
            span = slice(self.tree.rows.ptr[q], self.tree.rows.ptr[q + 1])
            value[self.dense[self.tree.rows.term[span]], j] = self.tree.rows.value[span]
        rows = self.docs.rows
        at, run = spread(rows.ptr[docs], np.diff(rows.ptr)[docs])
        local = self.dense[rows.term[at]]
        self.dense[term] = 0
        hit = np.flatnonzero(local)
        total = np.concatenate((np.zeros((1, len(items)), np.int64), np.cumsum(value[local[hit]] * rows.value[at[hit], None], axis=0)))
        stop = np.searchsorted(run[hit], np.arange(len(docs)), side="right")
        score = total[stop] - total[np.concatenate(([0], stop[:-1]))]
        for j, q in enumerate(items.tolist()):
            good = np.flatnonzero(score[:, j] >= self.floor[q])
            if not len(good):
                continue
            s, ids = np.concatenate((self.best[q][0], score[good, j])), np.concatenate((self.best[q][1], self.ids[docs[good]]))
            first = np.lexsort((ids, -s))[: self.k]
            self.best[q] = (s[first], ids[first])
            if len(first) == self.k:
                self.floor[q] = max(self.floor[q], s[first[-1]])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, id and score of all that is held."""
        size = [len(s) for s, _ in self.best]
        item = np.repeat(self.tree.order, size)
        return item, *(np.concatenate([b[c] for b in self.best]) if self.best else np.empty(0, np.int64) for c in (1, 0))


def _counted(words: pa.DictionaryArray, owner: np.ndarray, n: int, vocabulary: pa.Array) -> Sparse:
    """How often each text holds each term of the vocabulary."""
    number = pc.index_in(words.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = number[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
    known = np.flatnonzero(term >= 0)
    key = owner[known] * max(1, len(vocabulary)) + term[known]
    key.sort()
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(head, len(key)))
    row, term = np.divmod(key[head], max(1, len(vocabulary)))
    return Sparse(np.searchsorted(row, np.arange(n + 1)), term, count)


def _postings(docs: DataFrame, vocabulary, most: int = 1_000_000) -> DataFrame:
    """Number of terms of each document, and its terms of the vocabulary with counts."""

    def run(batches):
        known = pa.array(vocabulary.value, pa.large_binary())
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for i, j in slices(offsets, most):
                words, owner = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = _counted(words, owner, j - i, known)
                ptr = pa.array(rows.ptr.astype(np.int32))
                lists = [pa.ListArray.from_arrays(ptr, pa.array(x.astype(np.int32))) for x in (rows.term, rows.value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.bincount(owner, minlength=j - i)), *lists], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def _block(docs: DataFrame, items: list, k: int, share: int, size: int) -> DataFrame:
    """The best documents of each of a block of items (number, text): (item, id, score)."""
    spark = docs.sparkSession
    words, owner = _terms(*string_bytes(pa.array([t for _, t in items], pa.large_string())))
    vocabulary = words.dictionary.to_pylist()
    asked = _counted(words, owner, len(items), words.dictionary)
    number = np.asarray([r for r, _ in items], np.int64)
    rows = as_table(_postings(docs, spark.sparkContext.broadcast(vocabulary)), "postings")
    whole = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    seen = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # no more rows than the block has terms
        seen[r["term"]] = r["count"]
    total, length = whole["docs"], whole["terms"] or 1
    weight = np.asarray([math.floor(1000 * math.log((2 * total + 2) / (2 * int(c) + 1))) for c in seen], np.int64)

    def search(part: DataFrame, floor: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((asked.ptr, asked.term, asked.value, weight, floor, number))

        def run(batches):
            ptr, term, value, w, least, names = shared.value
            held, waiting = Search(Sparse(ptr, term, value), w, least, k), []

            def settle():
                t = pa.Table.from_batches(waiting).combine_chunks()
                if not t.num_rows:
                    return
                lists, tf = t["terms"].combine_chunks(), t["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                n = t["n"].to_numpy()
                m = np.repeat(25 + (75 * n * total) // length, size)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                ids = t["id"].fill_null(_NO_ID).to_numpy()
                held.add(Sparse(np.concatenate(([0], np.cumsum(size))), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), impact), ids)

            for batch in batches:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) >= size:
                    settle()
                    waiting = []
            if waiting:
                settle()
            item, ids, score = held.found()
            yield pa.RecordBatch.from_arrays([pa.array(names[item]), pa.array(ids), pa.array(score)], ["item", "id", "score"])

        return part.mapInArrow(run, "item long, id long, score long")

    floor = np.zeros(len(items), np.int64)
    sample = search(rows.filter(F.pmod(F.xxhash64("id", "n"), F.lit(share)) == 0), floor)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    kth = sample.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k)
    place = {int(r): i for i, r in enumerate(number)}
    for r in kth.select("item", "score").toLocalIterator():  # one row an item of the block
        floor[place[r["item"]]] = r["score"]
    best = search(rows, floor).withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 16_000_000, share: int = 64, size: int = 8192, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item.

    Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with
    only A-Z lower-cased. Items go through in blocks of about ``block_bytes`` of text, by
    a hash; what a block sends to the tasks is as large as the block, and it reads the
    documents once. Within a task documents meet the items ``size`` at a time.

    Every row of ``items`` is an item of its own, every row of ``docs`` a document; texts
    without a term, or null, find and are found by nothing. Null document ids come behind
    equal scores. Scores are 64-bit integers (their bounds must fit, too)."""
    spark = docs.sparkSession
    # Numbered as they are written: once, whatever is read again later.
    asked = as_table(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item}`").alias("name"), F.col(f"`{text}`").alias("text")), "items")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    found = None
    for b in range(blocks):
        own = asked.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)).select("item", "text")
        part = as_table(_block(rows, [(r["item"], r["text"]) for r in own.toLocalIterator()], k, share, size), "ranked")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item long, id long, score long, rank int")
    names = asked.select("item", F.col("name").alias(item))
    return found.join(names, "item").select(F.col(item), F.col("rank").cast("int"), F.nullif("id", F.lit(_NO_ID)).alias(key), "score")
