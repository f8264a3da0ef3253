"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

A document is the set of its distinct word shingles. Two permutations make its whole
signature: the first scatters the shingles over 2**32 places, the second, shifted
circularly by k, gives coordinate k as the least image of the occupied places.
Documents that agree in all rows of some band are candidates; a link is confirmed by
intersecting the full sets, word by word.

Documents with equal sets are one node from the start. A bucket is never expanded into
all its pairs: first each member is compared with one pivot, which joins nearly all of
a large group of near copies; after that only members of different components are
compared, so that no link between components is lost."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Runs, as_table, mix, slices, string_bytes, word_hashes, word_numbers, word_spans, working_tables
from .components import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(column: pa.Array, words: int = 4, most: int = 1_000_000, proof: bool = False):
    """Yields (i, the sorted distinct 64-bit shingle hashes of text i, and with ``proof``
    a second, independent hash of each). A-Z are lower-cased; a text with fewer words
    than a shingle is one shingle; a text without words, or null, has none."""
    data, offsets = string_bytes(column)
    for i, j in slices(offsets, most):
        part, offs = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, owner = word_spans(part, offs)
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        at = np.arange(len(owner))
        left = bounds[owner + 1] - at
        at = np.flatnonzero((left >= words) | (at == bounds[owner]))
        length = np.minimum(left[at], words)
        one, two = (Runs(word_hashes(part, starts, ends, seed)).hashes(at, length) if seed == 0 or proof else None for seed in (0, 1))
        bounds = np.searchsorted(at, bounds)
        for k in range(j - i):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if not proof:
                yield i + k, np.unique(one[a:b]), None
                continue
            order = np.argsort(one[a:b], kind="stable")
            s, t = one[a:b][order], two[a:b][order]
            same = s[1:] == s[:-1]
            if (same & (t[1:] != t[:-1])).any():  # one hash for two shingles: tell them apart by both
                order = np.lexsort((t, s))
                s, t = s[order], t[order]
                same = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
            new = np.concatenate(([True], ~same))[: b - a]
            yield i + k, s[new], t[new]


def signature(shingles: np.ndarray, coordinates: int, block: int = 1024) -> np.ndarray:
    """Circulant MinHash: coordinate k is min over the set of pi(sigma(x) + k), with
    sigma and pi bijections of the 32-bit numbers (sigma's input is the hash's top)."""
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)
    place = (shingles >> np.uint64(32)).astype(np.uint32)
    place = (place ^ (place >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    for at in range(0, len(place), block):
        v = place[at : at + block, None] + shift
        t = v >> np.uint32(16)
        v ^= t
        v *= np.uint32(0x7FEB352D)
        np.right_shift(v, np.uint32(15), out=t)
        v ^= t
        v *= np.uint32(0x846CA68B)
        np.right_shift(v, np.uint32(16), out=t)
        v ^= t
        np.minimum(out, v.min(0), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key ^ bands[:, r] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


PLANES = 3


def low_bits(sig: np.ndarray) -> np.ndarray:
    """The lowest ``PLANES`` bits of every coordinate, bit by bit, 64 to a word."""
    planes = [np.packbits((sig >> np.uint32(b) & 1).astype(np.uint8), bitorder="little") for b in range(PLANES)]
    return np.concatenate(planes).view(np.int64)


def sketches(docs: DataFrame, words: int, bands: int, rows: int, coordinates: int, key: str, text: str) -> DataFrame:
    """doc_id, n (set size), name (digest of the set), bands (keys) and bits (the
    low ones of each coordinate) of every row."""

    def run(batches):
        for batch in batches:
            sizes, names, keys, bits = [], [], [], []
            for _, s, proof in shingle_sets(batch.column(1), words, proof=True):
                sizes.append(len(s))
                if not len(s):
                    names.append(None)
                    keys.append(np.empty(0, np.int64))
                    bits.append(np.zeros(PLANES * coordinates // 64, np.int64))
                    continue
                sig = signature(s, max(coordinates, bands * rows))
                names.append(hashlib.blake2b(s.tobytes() + proof.tobytes(), digest_size=16).digest())
                keys.append(band_keys(sig[: bands * rows], rows))
                bits.append(low_bits(sig[:coordinates]))
            bounds = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat, low = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, bits))
            starts = np.arange(len(bits) + 1) * (PLANES * coordinates // 64)
            lists = [pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(v)) for b, v in ((bounds, flat), (starts, low))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), *lists], ["doc_id", "n", "name", "bands", "bits"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n long, name binary, bands array<long>, bits array<long>")


def _alone(texts: DataFrame, words: int) -> DataFrame:
    """(rep, alone): how many shingles of each text no other candidate has. Two sets
    cannot have more in common than the rest of the smaller, which rules out most pairs
    of copies that were edited in different places before they are made."""

    def run(batches):
        for batch in batches:
            for i, s, _ in shingle_sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), batch.column(0)[i].as_py())), pa.array(s.view(np.int64))], ["rep", "h"])

    each = texts.mapInArrow(run, "rep long, h long").groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    return each.filter("rep = other").groupBy("rep").agg(F.count("*").alias("alone"))


def similar(left: pa.Array, right: pa.Array, words: int, percent: int, most: int = 2_000_000) -> np.ndarray:
    """Which pairs of texts have 100 * intersection >= percent * union of their shingle
    sets. Shingles are numbered by their words, not hashed: the answer is exact."""
    keep = np.zeros(len(left), bool)
    sides = [string_bytes(x) for x in (left, right)]
    both = sides[0][1] + sides[1][1]
    for i, j in slices(both, most):
        n = j - i
        part = np.concatenate([_LOWER[d[o[i] : o[j]]] for d, o in sides])
        offs = np.concatenate((sides[0][1][i : j + 1] - sides[0][1][i], sides[0][1][j] - sides[0][1][i] + sides[1][1][i + 1 : j + 1] - sides[1][1][i]))
        starts, ends, owner = word_spans(part, offs)
        if not len(starts):
            continue
        # Numbers from 1 up, and words - 1 zeros behind each text: a short text is one shingle of its own kind.
        number = np.zeros(len(owner) + 2 * n * (words - 1), np.int64)
        at = np.arange(len(owner)) + owner * (words - 1)
        number[at] = word_numbers(part, starts, ends) + 1
        size, rank = 1, number
        while size < words:
            step = min(size, words - size)
            rank = np.unique(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
            size += step
        bounds = np.searchsorted(owner, np.arange(2 * n + 1))
        place = np.arange(len(owner))
        first = (bounds[owner + 1] - place >= words) | (place == bounds[owner])
        top = int(rank.max()) + 1
        own = np.unique(owner[first] * top + rank[at[first]])
        text = own // top
        sizes = np.bincount(text, minlength=2 * n)
        cut = int(np.searchsorted(text, n))
        shared = np.intersect1d(own[:cut], own[cut:] - n * top, assume_unique=True) // top
        common = np.bincount(shared, minlength=n)
        union = sizes[:n] + sizes[n:] - common
        keep[i:j] = (union > 0) & (100 * common >= percent * union)
    return keep


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, la, lb) whose texts are similar enough, as (la, lb)."""

    def run(batches):
        for batch in batches:
            keep = pa.array(similar(batch.column(2), batch.column(3), words, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], ["a", "b"])

    left = pairs.join(texts.select(F.col("rep").alias("b"), F.col("t").alias("tb")), "b")
    both = left.join(texts.select(F.col("rep").alias("a"), F.col("t").alias("ta")), "a")
    return both.select("la", "lb", "ta", "tb").mapInArrow(run, "a long, b long")


def _possible(percent: int, coordinates: int) -> Column:
    """Whether x and y (columns n1, shared1, bits1 and so on) can reach the similarity:
    by sizes and shared sizes for certain, and by their sketches but for a chance of
    4e-8. The low bits of two sets differ in (1 - similarity) (1 - 2**-PLANES) of the
    coordinates, give or take a binomial error, of which 5.4 deviations are allowed."""
    most = F.least("shared1", "shared2", "n1", "n2")
    p = (1 - percent / 100) * (1 - 0.5**PLANES)
    limit = int(coordinates * p + 5.4 * (coordinates * p * (1 - p)) ** 0.5) + 1
    words, apart = coordinates // 64, F.lit(0)
    for i in range(words):
        differ = F.col("bits1")[i].bitwiseXOR(F.col("bits2")[i])
        for plane in range(1, PLANES):
            differ = differ.bitwiseOR(F.col("bits1")[i + plane * words].bitwiseXOR(F.col("bits2")[i + plane * words]))
        apart = apart + F.bit_count(differ)
    return (100 * most >= percent * (F.col("n1") + F.col("n2") - most)) & (apart <= limit)


_ROW = ["rep", "n", "shared", "label"]


def _side(at: DataFrame, side: str, *more: str) -> DataFrame:
    return at.select("key", *[F.col(c).alias(c + side) for c in (*_ROW, *more)])


def _pivot_pairs(at: DataFrame, turn: int, possible: Column) -> DataFrame:
    """Each member of a bucket with one pivot of the bucket, another one each turn."""
    place = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
    pivot = at.groupBy("key").agg(F.min(F.struct(place.alias("place"), *_ROW, "bits")).alias("p")).select("key", *[F.col(f"p.{c}").alias(c + "1") for c in (*_ROW, "bits")])
    return _side(at, "2", "bits").join(pivot, "key").filter((F.col("label1") != F.col("label2")) & possible)


def _cross_pairs(at: DataFrame, possible: Column) -> DataFrame:
    """Members of a bucket in different components that can reach the similarity, each
    pair in the first band that they have in common. The largest component of a bucket
    meets the others, but not itself."""
    here = F.array_position(F.zip_with("marks1", "marks2", lambda a, b: a == b), True) == F.col("band1") + 1
    more = ("bits", "marks", "band")
    main, rest = at.filter("main"), at.filter("NOT main")
    one = _side(rest, "1", *more).join(_side(rest, "2", *more), "key").filter((F.col("label1") < F.col("label2")) & possible & here)
    two = _side(main, "1", *more).join(_side(rest, "2", *more), "key").filter(possible & here)
    return one.unionByName(two)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 42, rows: int = 5, coordinates: int = 384, pivots: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    42 bands of 5 rows miss a pair of similarity 0.8 with probability 6e-8. Documents
    without words, and rows with a null id, are linked with nothing and kept. Rows that
    share an id are one node. Equal texts always share a component; ties go to the
    smallest id; an empty table gives no rows; other columns are not read."""
    with working_tables(docs.sparkSession):
        sketch = as_table(sketches(docs, words, bands, rows, coordinates, key, text), "sketches")
        usable = sketch.filter("n > 0 AND doc_id IS NOT NULL")
        equal = as_table(usable.groupBy("name").agg(F.min(F.struct("doc_id", "n", "bands", "bits")).alias("m")).select("name", F.col("m.doc_id").alias("rep"), "m.n", "m.bands", "m.bits"), "equal-sets")
        nodes = equal.select("rep", "n", F.posexplode("bands").alias("band", "key"))
        # As a table of its own, so that the join has two plain sides and a hot bucket can be split.
        full = as_table(nodes.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "full-buckets")
        at = as_table(nodes.join(full, "key"), "buckets")
        wanted = at.select(F.col("rep").alias("doc_id")).distinct()
        texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).join(wanted, "doc_id", "left_semi")
        # Rows that share an id have several texts; each is compared.
        texts = as_table(texts.select(F.col("doc_id").alias("rep"), "t"), "candidate-texts")
        sizes = usable.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("n").alias("all")).join(_alone(texts, words), "rep", "left")
        shared = equal.join(wanted.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").join(sizes, "rep").withColumn("shared", F.col("all") - F.coalesce("alone", F.lit(0)))
        more = as_table(shared.filter(100 * F.col("shared") >= percent * F.col("n")).select("rep", "n", "shared", "bits", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("marks")), "candidates")
        at = at.join(more.select("rep", "n", "shared"), ["rep", "n"]).withColumn("label", F.col("rep"))
        possible = _possible(percent, coordinates)

        steps = []  # maps from the labels of one turn to those of the next
        for turn in range(pivots + 1):
            sizes = at.groupBy("key", "label").agg(F.count("*").alias("g")).groupBy("key").agg(F.count("*").alias("labels"), F.sum("g").alias("m"), F.sum(F.col("g") * F.col("g")).alias("q"), F.max(F.struct("g", "label")).alias("top")).filter("labels > 1")
            at = as_table(at.join(sizes.select("key", "m", "q", F.col("top.label").alias("top")), "key").select("key", "band", *_ROW, (F.col("label") == F.col("top")).alias("main"), (F.lit(0.5) * (F.col("m") - F.col("q") / F.col("m"))).alias("pairs")), "open-buckets")
            total = at.agg(F.sum("pairs").alias("pairs"), F.count("*").alias("rows")).first()
            if not total["rows"]:
                break
            last = turn == pivots or total["pairs"] <= 2 * total["rows"]
            at = at.drop("pairs")
            wide = at.join(more.select("rep", "n", "bits", *(["marks"] if last else [])), ["rep", "n"])
            pairs = _cross_pairs(wide, possible) if last else _pivot_pairs(wide, turn, possible)
            pairs = pairs.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b"), F.col("label1").alias("la"), F.col("label2").alias("lb")).dropDuplicates(["a", "b"])
            step = components(_confirm(pairs, texts, words, percent))
            steps.append(step)
            if last:
                break
            at = at.join(step, at["label"] == step["node"], "left").select("key", "band", "rep", "n", "shared", F.coalesce(step["label"], at["label"]).alias("label"))

        # Rows that share an id tie their sets together.
        ids = equal.select(F.col("rep").alias("label"), "name")
        for step in steps:
            ids = ids.join(step.withColumnRenamed("label", "to"), ids["label"] == step["node"], "left").select("name", F.coalesce("to", "label").alias("label"))
        named = usable.select("doc_id", "name").join(ids, "name")
        tied = components(named.select(F.col("doc_id").alias("a"), F.col("label").alias("b")))
        out = sketch.join(tied, sketch["doc_id"] == tied["node"], "left")
        component = F.coalesce(F.col("label"), F.col("doc_id"))
        return as_table(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "near-duplicates", keep=True)
