"""Exact top-k inner products by dual cover-tree search.

Vectors are dealt into cells around a bounded number of centres, one a block of them at
most, and queries into groups around one centre a group. A first pass searches each query's own cell for a floor of its kth
score. For a group and a cell (and for nodes of their trees) with centres q and r and
covering radii, no inner product below them exceeds q.r + R_q |r| + R_r |q| + R_q R_r;
cells that cannot reach the worst floor of a group are never dealt to it. Each task
indexes one group and one block of a cell with cover trees and walks both together,
dropping pairs of nodes against the worst kth score of the node's queries."""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_table


class Node:
    __slots__ = ("centre", "radius", "points", "children", "norm", "level")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, children: list, level: int | None = None):
        self.centre, self.radius, self.points, self.children, self.level = centre, radius, points, children, level
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(x: np.ndarray, rows: np.ndarray, leaf: int = 48, base: float = 1.3, centre: int | None = None) -> Node:
    """A cover tree: a node of level i covers its points within base**i, its children,
    itself among them, stand more than base**(i - 1) apart and cover the points within
    that distance. Levels at which a node would only have itself below it are left out.
    Nodes with few points are leaves; children that cover fewer points than a leaf holds
    are gathered in leaves of their parent, for a product costs less than their bounds."""
    own = rows[0] if centre is None else centre
    d = x[rows] - x[own]
    radius = float(np.sqrt(np.einsum("ij,ij->i", d, d).max()))
    if len(rows) <= leaf or radius == 0:
        return Node(x[own], radius, rows, [])
    level = int(np.floor(np.log(radius) / np.log(base)))
    while base**level < radius:
        level += 1
    reach = min(base ** (level - 1), radius * (1 - 1e-12))
    rest, groups, alone = rows, [], []
    nearest = own
    while len(rest):
        d = x[rest] - x[nearest]
        inside = np.einsum("ij,ij->i", d, d) <= reach * reach
        inside |= rest == nearest
        members = rest[inside]
        (groups if len(members) >= leaf else alone).append((nearest, members))
        rest = rest[~inside]
        nearest = rest[0] if len(rest) else -1
    children = [cover_tree(x, m, leaf, base, c) for c, m in groups]
    single = np.concatenate([m for _, m in alone]) if alone else np.zeros(0, np.int64)
    for at in range(0, len(single), 512):
        part = single[at : at + 512]
        d = x[part] - x[own]
        children.append(Node(x[own], float(np.sqrt(np.einsum("ij,ij->i", d, d).max())), part, []))
    return Node(x[own], radius, rows, children, level)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id. Scores below
    a query's ``floor`` are of no use to it."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.least = k, floor.astype(np.float64)
        self.score = np.full((len(floor), k), -np.inf)
        self.ids = np.full((len(floor), k), np.iinfo(np.int64).max)

    def worst(self, queries: np.ndarray) -> float:
        return float(self.least[queries].min())

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        hit = scores >= np.maximum(self.least[queries], np.finfo(np.float64).min)[:, None]
        for i in np.flatnonzero(hit.any(1)):
            q, at = queries[i], np.flatnonzero(hit[i])
            new = scores[i, at]
            if len(at) > k:  # the kth best and all its equals
                keep = new >= np.partition(new, len(new) - k)[len(new) - k]
                at, new = at[keep], new[keep]
            s, v = np.concatenate((self.score[q], new)), np.concatenate((self.ids[q], ids[at]))
            order = np.lexsort((v, -s))[:k]
            self.score[q], self.ids[q] = s[order], v[order]
            self.least[q] = max(self.least[q], s[order[-1]])


def _most(dot, a_radius, a_norm, b_radius, b_norm):
    """No inner product of points within the radii of two centres is greater."""
    most = dot + a_radius * b_norm + b_radius * a_norm + a_radius * b_radius
    return most + np.abs(most) * 1e-12 + 1e-6


def dual_search(q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, k: int) -> Best:
    """Best first over pairs of nodes. A query (named by its row) does not meet itself."""
    best, tick = Best(k, floor), count()
    left, right = cover_tree(q, np.arange(len(q))), cover_tree(x, np.arange(len(x)))

    def bound(a: Node, b: Node) -> float:
        return float(_most(a.centre @ b.centre, a.radius, a.norm, b.radius, b.norm))

    queue = [(-bound(left, right), next(tick), left, right)]
    while queue:
        most, _, a, b = heapq.heappop(queue)
        if -most < best.worst(a.points):
            continue
        if not a.children and not b.children:
            scores = q[a.points] @ x[b.points].T
            scores[q_rows[a.points][:, None] == x_rows[b.points]] = -np.inf
            best.add(a.points, scores, x_ids[b.points])
            continue
        split_b = b.children and (not a.children or b.radius >= a.radius)
        for c in b.children if split_b else a.children:
            pair = (a, c) if split_b else (c, b)
            if (m := bound(*pair)) >= best.worst(pair[0].points):
                heapq.heappush(queue, (-m, next(tick), *pair))
    return best


def _whole(column, d: int, scale: float) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.astype(np.float64)).reshape(len(column), d)


def _distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance from it."""
    near = np.empty(len(x), np.int64)
    square = np.einsum("ij,ij->i", centres, centres)
    for at in range(0, len(x), 4096):
        near[at : at + 4096] = (square - 2 * (x[at : at + 4096] @ centres.T)).argmin(1)
    d = x - centres[near]
    return near, np.sqrt(np.einsum("ij,ij->i", d, d)) * (1 + 1e-12)


def top_k(rows: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0, block: int = 4096, queries: int = 1024, centres: int = 128, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best partners of every row whose id is
    divisible by ``every``, by inner product of the vectors floor(scale * x).

    Every row is a candidate for every query but itself; rows that repeat an id are rows
    of their own, as queries too. Vectors that are null or hold null or non-finite
    components, and null ids, take no part; vectors of unequal length do not meet. Scores
    are exact while they stay below 2**53 in size. Queries with fewer partners than k get
    all; an empty vector scores 0 with its like. At most ``centres`` centres for each
    length of vectors are sent to all tasks, and nothing else."""
    spark = rows.sparkSession
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    # Numbered as they are written: once, whatever is read again later.
    good = as_table(rows.filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), "top-vectors")
    number = F.xxhash64("row")
    asked = F.pmod("id", F.lit(every)) == 0
    drawn = good.groupBy(F.size("v").alias("d"), F.pmod(number, F.lit(centres)).alias("part")).agg(F.min_by("v", F.struct(number, "row")).alias("v"), F.count("*").alias("n"), F.count_if(asked).alias("asked")).collect()
    middle: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["d"] for r in drawn}:
        own = sorted((r for r in drawn if r["d"] == d), key=lambda r: r["part"])
        whole = np.floor(scale * np.asarray([r["v"] for r in own], np.float64)).reshape(len(own), d)
        whole = whole[np.sort(np.unique(whole, axis=0, return_index=True)[1])] if d else whole[:1]
        middle[d] = tuple(whole[: max(1, -(-sum(r[c] for r in own) // size))] for c, size in (("n", block), ("asked", queries)))
    shared = spark.sparkContext.broadcast(middle)

    def assign(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                cells, homes = shared.value[d]
                x = _whole(part.column(2), d, scale)
                cell, radius = _distances(x, cells)
                home, far = np.full(len(x), -1), np.zeros(len(x))
                if len(at := np.flatnonzero(part.column(1).to_numpy() % every == 0)):
                    home[at], far[at] = _distances(x[at], homes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), d, np.int32)), *map(pa.array, (cell, radius, home, far)), *part.columns], ["d", "cell", "radius", "home", "far", "row", "id", "v"])

    schema = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("radius", T.DoubleType()), T.StructField("home", T.LongType()), T.StructField("far", T.DoubleType()), *good.schema.fields])
    near = as_table(good.mapInArrow(assign, schema), "top-cells")
    parts = F.greatest(F.lit(1), F.ceil(F.count_if(asked) / queries)).cast("int")
    cells = near.groupBy("d", "cell").agg(F.max("radius").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), parts.alias("parts"))
    cells = as_table(cells, "top-cell-sizes")
    homes = near.filter(asked).groupBy("d", "home").agg(parts.alias("groups"))
    data = near.join(cells.select("d", "cell", "blocks", "parts"), ["d", "cell"]).select("d", "cell", F.pmod(number, F.col("blocks")).cast("int").alias("b"), "parts", "row", "id", "v")
    dealt = F.xxhash64("row", F.lit("q"))
    asks = near.filter(asked).join(homes, ["d", "home"]).select("d", "cell", "home", F.pmod(dealt, F.col("groups")).cast("int").alias("g"), "far", "row", "id", "v")

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        d = x["d"][0].as_py()
        own, floor = q["row"].to_numpy(), q["floor"].to_numpy()
        best = dual_search(_whole(q["v"], d, scale), own, floor, _whole(x["v"], d, scale), x["row"].to_numpy(), x["id"].to_numpy(), k)
        i, j = np.nonzero(np.isfinite(best.score))
        return pa.table({"row": own[i], "query_id": q["id"].to_numpy()[i], "vec_id": best.ids[i, j], "score": best.score[i, j].astype(np.int64)})

    hits = "row long, query_id long, vec_id long, score long"
    # The floor: the kth score among one block of the query's own cell.
    home = asks.join(cells.select("d", "cell", "parts"), ["d", "cell"]).select(*[F.col(c).alias(c) for c in ("d", "cell", "row", "id", "v")], F.pmod(dealt, F.col("parts")).cast("int").alias("p"), F.lit(float("-inf")).alias("floor"))
    sample = data.filter("b = 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = sample.groupBy("d", "cell", "p").cogroup(home.groupBy("d", "cell", "p")).applyInArrow(search, hits)
    floors = as_table(first.groupBy("row").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).select("row", "floor"), "top-floors")
    asks = as_table(asks.drop("cell").join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "top-queries")
    radii = {(r["d"], r["cell"]): r["radius"] for r in cells.select("d", "cell", "radius").collect()}  # one row a centre

    def reachable(batches):
        for batch in batches:
            out = []
            for d, h, g, far, floor in zip(*(c.to_pylist() for c in batch.columns)):
                own, centre = shared.value[d][0], shared.value[d][1][h]
                radius = np.asarray([radii.get((d, c), -1.0) for c in range(len(own))])
                norm = np.sqrt(np.einsum("ij,ij->i", own, own))
                most = _most(own @ centre, far, np.sqrt(centre @ centre), np.maximum(radius, 0), norm)
                out += [(d, h, g, int(c)) for c in np.flatnonzero((most >= floor) & (radius >= 0))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["d", "home", "g", "cell"])

    groups = asks.groupBy("d", "home", "g").agg(F.max("far").alias("far"), F.min("floor").alias("floor"))
    pairs = as_table(groups.mapInArrow(reachable, "d int, home long, g int, cell long"), "top-pairs")
    keys = ["d", "cell", "b", "home", "g"]
    left = data.drop("parts").join(pairs, ["d", "cell"])
    blocks = cells.select("d", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    right = asks.join(pairs.join(blocks, ["d", "cell"]), ["d", "home", "g"]).select(*[F.col(c).alias(c) for c in (*keys, "row", "id", "v", "floor")])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, hits)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
