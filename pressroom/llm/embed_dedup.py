"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of a few dimensions. If the squared
distance of two vectors is at most t, then in at least one block it is at most that
block's share of t, in proportion to its dimensions. So each block is joined on its own
under its budget and the union of what the blocks find is checked by the exact cosine.

A block's range join is a grid over its first two coordinates, with cells twice as wide
as the budget's root: a vector is dealt to its own cell and to those neighbours behind
it that lie within the root, about 2.5 copies a block whatever the number of vectors.
In a cell, a third coordinate in order limits what is compared. A pair counts in the
first block that finds it and nowhere else, so no pair leaves the task that found it:
tasks give sums of links and a spanning forest. Cells with many vectors are cut into
chunks, and each pair of chunks is a group of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_table
from .components import components

_ROOM = 1e-9


def rotate(x: np.ndarray) -> np.ndarray:
    """Unit vectors under seeded signs and a Walsh-Hadamard transform, an orthogonal
    map, on the next power of 2 of dimensions. Only element-wise sums in fixed order:
    a vector's image has the same bits in every task."""
    n, d = x.shape
    size = 1 << max(0, int(d - 1).bit_length())
    u = np.zeros((n, size))
    u[:, :d] = x
    square = np.zeros(n)
    for c in range(d):
        square += u[:, c] * u[:, c]
    u /= np.sqrt(square)[:, None]
    u *= np.where(np.random.default_rng(5).random(size) < 0.5, -1.0, 1.0)
    step = 1
    while step < size:
        v = u.reshape(n, -1, 2, step)
        u = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), 2).reshape(n, size)
        step *= 2
    return u / np.sqrt(size)


def blocks_of(size: int, blocks: int) -> list[tuple[int, int]]:
    edges = [round(k * size / min(blocks, size)) for k in range(min(blocks, size) + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for c in range(a.shape[1]):
        d = a[:, c] - b[:, c]
        out += d * d
    return out


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), kind) for v in column]).astype(np.float64)


def _forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


#: A cell meets the cells at these distances: of any two neighbours, one is in front.
_AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def _cells(u: np.ndarray, lo: int, hi: int, root: float):
    """(rows, cell, role) for a block: role 3 in the own cell, 4 in those behind it."""
    width, n = 2 * root, len(u)
    own, near = [], []
    for c in (lo, min(lo + 1, hi - 1)):
        f = np.floor(u[:, c] / width)
        own.append(f.astype(np.int64))
        near.append({0: np.ones(n, bool), 1: u[:, c] - f * width <= root * (1 + _ROOM), -1: (f + 1) * width - u[:, c] <= root * (1 + _ROOM)})
    if hi - lo == 1:
        own[1] = np.zeros(n, np.int64)
    yield np.arange(n), own[0] * (1 << 31) + own[1], 3
    for d, e in _AHEAD:
        if hi - lo > 1 or e == 0:
            rows = np.flatnonzero(near[0][d] & near[1][e])
            yield rows, (own[0][rows] - d) * (1 << 31) + own[1][rows] - e, 4


def near_vectors(rows: DataFrame, cosine: float = 0.93, blocks: int = 8, crowd: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Only vectors of equal label and length are compared. Vectors that are null, empty,
    zero, or hold null or non-finite components, and rows with a null label or id, link
    with nothing. Equal vectors of a label are compared once and counted as often as they
    stand; rows that repeat an id count as vectors of their own with that id. ``crowd``:
    vectors of a cell above which it is cut."""
    budget = 2 - 2 * cosine + _ROOM
    wide = not isinstance(rows.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f8" if wide else "<f4"
    v = F.col(vector).cast("array<double>") if wide else F.col(vector)
    sound = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    own = rows.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    good = own.filter("sound")
    # Classes of equal vectors are numbered as they are written: once, whatever is read again later.
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("c"))
    reps = as_table(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    label_type = rows.schema[label].dataType

    def placed(batches):
        """(part of a batch with vectors of one length, images, block, rows, cells, role)"""
        for batch in batches:
            d = batch.column(1).to_numpy(zero_copy_only=False)
            for size in np.unique(d):
                part = batch.take(pa.array(np.flatnonzero(d == size)))
                x = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)
                u = rotate(x.astype(np.float64))
                for j, (lo, hi) in enumerate(blocks_of(u.shape[1], blocks)):
                    for at, cell, role in _cells(u, lo, hi, np.sqrt(budget * (hi - lo) / u.shape[1])):
                        if len(at):
                            yield part, x, j, at, cell, role

    def count(batches):
        for part, _, j, at, cell, _ in placed(batches):
            head = pa.table({"label": part.column(0).take(pa.array(at)), "d": part.column(1).take(pa.array(at)), "cell": cell})
            sums = head.group_by(["label", "d", "cell"]).aggregate([([], "count_all")])
            for b in sums.select(["label", "d", "cell", "count_all"]).to_batches():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, j, np.int32)), b.column(2), b.column(3)], ["label", "d", "j", "cell", "n"])

    def deal(batches):
        for part, x, j, at, cell, role in placed(batches):
            take = pa.array(at)
            v = pa.array([r.tobytes() for r in np.ascontiguousarray(x[at].astype(kind))], pa.binary())
            fill = [pa.array(np.full(len(at), k, np.int32)) for k in (j, role)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), fill[0], pa.array(cell), fill[1], part.column(2).take(take), part.column(3).take(take), v], ["label", "d", "j", "cell", "role", "rep", "c", "v"])

    head = [T.StructField("label", label_type), T.StructField("d", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("cell", T.LongType())]
    counted, dealt = T.StructType([*head, T.StructField("n", T.LongType())]), T.StructType([*head, T.StructField("role", T.IntegerType()), T.StructField("rep", T.LongType()), T.StructField("c", T.LongType()), T.StructField("v", T.BinaryType())])
    given = reps.select("label", F.size("v").alias("d"), "rep", "c", "v")
    place = ["label", "d", "j", "cell"]
    crowded = as_table(given.mapInArrow(count, counted).groupBy(place).agg(F.sum("n").alias("n")).filter(F.col("n") > crowd).select(*place, F.ceil(F.col("n") / crowd).cast("int").alias("chunks")), "crowded-cells")
    # Groups (p, q) of a cell hold pairs of a first vector of chunk p and a second one of
    # chunk q. Role 1: first of a pair; 2: second, of the same cell; 3: both; 4: second, of the next cell.
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("rep"), chunks).cast("int")

    def group(p, q, role):
        return F.struct(p.alias("p"), q.alias("q"), role.alias("role"))

    every = F.sequence(F.lit(0), chunks - 1)
    home = F.concat(
        F.transform(every, lambda q: group(mine, q, F.when(q == mine, 3).otherwise(1))),
        F.transform(F.filter(every, lambda p: p < mine), lambda p: group(p, mine, F.lit(2))),
    )
    behind = F.transform(every, lambda p: group(p, mine, F.lit(4)))
    spread = given.mapInArrow(deal, dealt).join(crowded, place, "left").select(*place, F.explode(F.when(F.col("role") == 3, home).otherwise(behind)).alias("g"), "rep", "c", "v")
    grouped = spread.select(*place, "g.p", "g.q", "g.role", "rep", "c", "v").groupBy(*place, "p", "q")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        role, j = group["role"].to_numpy(), int(group["j"][0].as_py())
        rep, c = group["rep"].to_numpy(), group["c"].to_numpy()
        first, second = np.flatnonzero(role & 1), np.flatnonzero(role & 6)
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(first) and len(second):
            x = _matrix(group["v"], kind)
            u = rotate(x)
            parts = blocks_of(u.shape[1], blocks)
            share = [budget * (hi - lo) / u.shape[1] for lo, hi in parts]
            lo, hi = parts[j]
            b = np.ascontiguousarray(u[:, lo:hi])
            square = np.einsum("ij,ij->i", b, b)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            z, reach = b[:, min(2, hi - lo - 1)], np.sqrt(share[j]) * (1 + _ROOM)
            first, second = first[np.argsort(z[first])], second[np.argsort(z[second])]
            for at in range(0, len(first), 256):
                a = first[at : at + 256]
                s = second[np.searchsorted(z[second], z[a[0]] - reach) : np.searchsorted(z[second], z[a[-1]] + reach, side="right")]
                near = square[a, None] + square[s] - 2 * (b[a] @ b[s].T) <= share[j] + 1e-7
                i, k = np.nonzero(near)
                i, k = a[i], s[k]
                once = (role[i] != 3) | (role[k] != 3) | (i < k)  # a chunk against itself: each pair once
                i, k = i[once], k[once]
                linked = np.einsum("ij,ij->i", x[i], x[k]) / (norm[i] * norm[k]) >= cosine
                i, k = i[linked], k[linked]
                mine = _square(u[i, lo:hi], u[k, lo:hi]) <= share[j]
                for m in range(j):
                    begin, end = parts[m]
                    mine &= _square(u[i, begin:end], u[k, begin:end]) > share[m]
                found_a.append(i[mine])
                found_b.append(k[mine])
        i, k = np.concatenate(found_a), np.concatenate(found_b)
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i, c[k])
        np.add.at(links, k, c[i])
        forest = _forest(rep[i], rep[k])
        hit = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[hit]), "links": pa.array(links[hit]), "low": pa.array([forest[r] for r in rep[hit].tolist()], pa.int64())})

    found = as_table(grouped.applyInArrow(compare, "rep long, links long, low long"), "vector-links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = labels.select(F.col("node").alias("rep"), F.col("label").alias("part"))
    nodes = as_table(reps.join(sums, "rep", "left").join(of, "rep", "left").select("label", "v", "least", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("part", "rep").alias("part")), "vector-classes")
    # A component is named by the least id of its vectors; those of one class have their own.
    named = nodes.join(of.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.min("least").alias("name"))
    nodes = nodes.join(named, "part", "left").select("label", "v", "n_links", F.coalesce("name", "least").alias("component_id"))
    joined = good.select("vec_id", "label", "v").join(nodes, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = own.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
