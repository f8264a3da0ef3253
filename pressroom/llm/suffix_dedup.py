"""Removal of byte strings that stand at more than one place of the corpus.

Every window of consecutive bytes has one anchor: its least gram by hash, the leftmost of
equals. Consecutive windows with one anchor make a segment. Equal windows have equal
anchors, so only segments whose anchor occurs again can hold a repeated window, and those
of one anchor meet in one string. The distinct segments of an anchor, weighted by how
often each occurs, are put one after the other, and the suffixes of that string are
sorted by grouping (``lyndon``), thousands of strings at once. Windows that stand at two
places are neighbours in that order which agree in all their bytes.

Neighbouring segments that are alone with their anchors (whole copies) share one string.
An anchor with many different segments (the edge of a passage that a large part of the
corpus shares) makes no string, which would be as long as the corpus: such segments are
compared block by block of window starts, as neighbours in the order of 128-bit names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Runs, as_table, input_partitions, mix, slices, string_bytes, working_tables
from .lyndon import spread, suffix_arrays

_PLACE = np.uint64((1 << 28) - 1)
_PART = "c1 long, c2 long, shift int, span int, n long, lead int"


def _strided(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at every place, as one number."""
    return np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes: 8, 16, 32, ..."""
    grams, width = mix(_strided(data)), 8
    while width < gram:
        grams, width = Runs._join(grams[:-width], grams[width:], width), 2 * width
    return grams[: max(0, len(data) - gram + 1)]


def _ranked(grams: np.ndarray) -> np.ndarray:
    """What is least for the anchor: by hash, then by place, which stands in the low bits."""
    return (mix(grams) & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last window start, place of the anchor and text number of
    every segment. ``gram``: 8, 16, 32, ..., at most the window."""
    none = np.empty(0, np.int64)
    length = np.diff(offsets)
    fits = np.maximum(length - window + 1, 0)
    if not fits.any():
        return none.astype(np.uint64), none, none, none, none
    grams = _grams(data, gram)
    least = _ranked(grams)
    have, wide = 1, window - gram + 1
    while have < wide:  # minimum over `have` places, doubled until it covers the window
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start, owner = spread(offsets[:-1], fits)
    anchor = (least[start] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    return grams[anchor[head]], start[head], start[np.append(head[1:], len(start)) - 1], anchor[head], owner[head]


def _names(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for the bytes of every span."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), end.tolist())]), "<i8").reshape(-1, 2)


def _occurrences(texts: DataFrame, window: int, gram: int, most: int = 1_000_000) -> DataFrame:
    """Anchor (h), name of the bytes (c1, c2), row and place of every segment, and how far
    behind its first window start the anchor is (lead)."""

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            for i, j in slices(offsets, most):
                part, offs = np.ascontiguousarray(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                h, first, last, anchor, owner = segments(part, offs, window, gram)
                if not len(h):
                    continue
                name, rows = _names(part, first, last + window), pa.array(owner + i)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(name[:, 0]), pa.array(name[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((first - offs[owner]).astype(np.int32)), pa.array((last - offs[owner]).astype(np.int32)), pa.array((anchor - first).astype(np.int32))], ["h", "c1", "c2", "rk", "rl", "first", "last", "lead"])

    return texts.select("rk", "rl", "t").mapInArrow(run, "h long, c1 long, c2 long, rk long, rl int, first int, last int, lead int")


def _strings(wanted: DataFrame, window: int, gram: int, crowd: int, long: int = 4096) -> DataFrame:
    """The bytes of the wanted segments of each text. ``parts`` says which windows of the
    string belong to which segment; segments that are alone with their anchors and follow
    each other share a string, up to ``long`` bytes or so. Of others ``left`` and ``right``
    are hashes of the bytes next to the anchor: two that share a window agree on one side
    of it in half of what the window has beside the anchor (null: not so many bytes)."""
    side = -(-(window - gram) // 2)

    def run(batches):
        for batch in batches:
            routes, crowded, lefts, rights, parts, data = [], [], [], [], [], []
            for value, rows in zip(batch.column(0), batch.column(1)):
                raw, runs = value.as_buffer(), []
                for s in sorted(rows.as_py(), key=lambda s: s["first"]):
                    if runs and s["k"] == 1 and runs[-1][-1]["k"] == 1 and s["first"] == runs[-1][-1]["last"] + 1 < runs[-1][0]["first"] + long:
                        runs[-1].append(s)
                    else:
                        runs.append([s])
                for own in runs:
                    a, b = own[0]["first"], own[-1]["last"] + window
                    at = a + own[0]["lead"]
                    routes.append(own[0]["h"])
                    crowded.append(own[0]["k"] > crowd)
                    lefts.append(_eight(raw[at - side : at]) if at - side >= a else None)
                    rights.append(_eight(raw[at + gram : at + gram + side]) if at + gram + side <= b else None)
                    parts.append([{"c1": s["c1"], "c2": s["c2"], "shift": s["first"] - a, "span": s["last"] - s["first"] + 1, "n": s["n"], "lead": s["lead"]} for s in own])
                    data.append(raw[a:b].to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), pa.array(crowded, pa.bool_()), pa.array(lefts, pa.int64()), pa.array(rights, pa.int64()), pa.array(parts, _PARTS), pa.array(data, pa.binary())], ["route", "crowded", "left", "right", "parts", "data"])

    return wanted.mapInArrow(run, f"route long, crowded boolean, left long, right long, parts array<struct<{_typed(_PART)}>>, data binary")


def _eight(raw) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(raw), "big", signed=True)


def met(routes: np.ndarray, side: pa.ChunkedArray) -> np.ndarray:
    """Which strings have the side's hash of another string of their route."""
    key = side.fill_null(0).to_numpy()
    have = np.flatnonzero(side.is_valid().to_numpy())
    order = have[np.lexsort((key[have], routes[have]))]
    same = (routes[order][1:] == routes[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _typed(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in fields.split(", ")))


_PARTS = pa.list_(pa.struct([("c1", pa.int64()), ("c2", pa.int64()), ("shift", pa.int32()), ("span", pa.int32()), ("n", pa.int64()), ("lead", pa.int32())]))


def _blocks(asked: DataFrame, window: int, size: int) -> DataFrame:
    """Blocks of ``size`` window starts that a crowded segment has a part in, counted from
    its anchor; of the list ``blocks`` (``size`` * 4 wide), if there is one, only. k1, k2
    name the bytes that all windows of the block share, w1, w2 those that they cover (null
    if the segment does not hold them all)."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for row in batch.to_pylist():
                view, span = memoryview(row["data"]), row["span"]
                zero = window - row["lead"]  # of the first window start
                within = range(zero // size, (zero + span - 1) // size + 1)
                for b in within if row["blocks"] is None else [c for w in sorted(row["blocks"]) for c in range(4 * w, 4 * w + 4) if c in within]:
                    low, high = b * size - zero, b * size + size - 1 - zero
                    core = xxhash.xxh3_128_digest(view[high : max(high, low + window)], b)
                    whole = xxhash.xxh3_128_digest(view[low : high + window], b) if low >= 0 and high < span else None
                    two = np.frombuffer(core + (whole or bytes(16)), "<i8").tolist()
                    values = (row["c1"], row["c2"], row["n"], b, *two[:2], *(two[2:] if whole else (None, None)))
                    for c, v in zip(out, values):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(out)], ["c1", "c2", "n", "b", "k1", "k2", "w1", "w2"])

    return asked.select("c1", "c2", "n", "span", "lead", "data", "blocks").mapInArrow(run, "c1 long, c2 long, n long, b int, k1 long, k2 long, w1 long, w2 long")


def judged(batches):
    """Blocks in the order of (k1, k2, w1, w2), with what each says about its neighbours.
    hit: the next block before or behind holds the same bytes (n > 1 is not looked at).
    refine: the first of those that hold the same bytes, if others share its core. edge:
    the first and the last block, whose other neighbour is not seen here; they are refined
    whatever they are. Blocks that are none of these are left out."""
    names = ["c1", "c2", "b", "k1", "k2", "w1", "w2"]

    def settle(rows: pa.Table, start: int, begins: bool, ends: bool):
        k1, k2, w1, w2 = (rows[c].fill_null(0).to_numpy() for c in names[3:])
        whole = rows["w1"].is_valid().to_numpy()
        core = np.concatenate(([False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]), [False]))
        same = np.concatenate(([False], core[1:-1] & whole[1:] & whole[:-1] & (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]), [False]))
        edge = np.zeros(len(k1), bool)
        edge[:1], edge[-1:] = begins, ends
        refine, head = edge.copy(), np.flatnonzero(~same[:-1])
        refine[head] |= core[head] | np.append(core[head[1:]], True)  # where the last ones end is not known
        hit = same[:-1] | same[1:]
        at = np.flatnonzero(hit | refine)
        at = at[(at >= start) & (at < len(k1) - (not ends))]
        out = rows.select(names).take(pa.array(at))
        for name, flags in (("hit", hit), ("refine", refine), ("edge", edge)):
            out = out.append_column(name, pa.array(flags[at]))
        return out.to_batches()

    held, start, begins = None, 0, True  # the last two blocks: one that is settled, one that waits for the next
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held else rows
        if len(rows) > start + 1:
            yield from settle(rows, start, begins, False)
            held, start, begins = rows.slice(len(rows) - 2), 1, False
        else:
            held = rows
    if held:
        yield from settle(held, start, begins, True)


def _crowded(crowds: DataFrame, window: int) -> DataFrame:
    """(c1, c2, from, to) of the repeated windows of segments with a crowded anchor.

    Equal windows stand at one distance from their anchor, so they are in the same block
    of window starts and agree in the bytes that the block's windows share, its core. The
    blocks are sorted by core and bytes over all partitions. Where two hold the same bytes,
    all windows are repeated; where one shares its core with others, the windows that they
    may share are found by cutting in four the first of each kind, down to one window. So
    a block that many segments hold is looked at once, and no block meets a group."""
    name, asked = ["c1", "c2"], crowds.withColumn("blocks", F.lit(None).cast("array<int>"))
    own = crowds.select(*name, "n", "span", (F.lit(window) - F.col("lead")).alias("zero"))
    found = own.filter("n > 1").select(*name, F.col("zero").alias("low"), (F.col("zero") + F.col("span") - 1).alias("high"))
    order = ["k1", "k2", "w1", "w2", *name]
    for size in (64, 16, 4, 1):
        rows = as_table(_blocks(asked, window, size), "crowded-blocks")
        dealt = rows.repartitionByRange(input_partitions(crowds), *order).sortWithinPartitions(*order)
        told = as_table(dealt.mapInArrow(judged, "c1 long, c2 long, b int, k1 long, k2 long, w1 long, w2 long, hit boolean, refine boolean, edge boolean"), "crowded-told")
        # Two blocks of each partition at most: neighbours that the cut between partitions parts.
        alike = F.count("w1").over(Window.partitionBy("k1", "k2", "w1", "w2"))
        parted = told.filter("edge").withColumn("alike", alike).filter("alike > 1")
        hits = told.filter("hit").select(*name, "b").unionByName(parted.select(*name, "b"))
        found = found.unionByName(hits.select(*name, (F.col("b") * size).alias("low"), (F.col("b") * size + size - 1).alias("high")))
        if size > 1:
            asked = crowds.join(told.filter("refine").groupBy(*name).agg(F.collect_set("b").alias("blocks")), name)
    near = found.groupBy(*name).agg(F.collect_set(F.struct("low", "high")).alias("own")).join(own.select(*name, "zero"), name)
    return near.select(*name, F.explode("own").alias("x"), "zero").select(*name, (F.col("x.low") - F.col("zero")).alias("from"), (F.col("x.high") - F.col("zero")).alias("to"))


def _agree(raw: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Which pairs of windows, by their starts, hold the same bytes."""
    cells, live = _strided(raw), np.arange(len(a))
    for at in [*range(0, window - 8, 8), window - 8] if window >= 8 else range(window):
        live = live[(cells if window >= 8 else raw)[a[live] + at] == (cells if window >= 8 else raw)[b[live] + at]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated_windows(routes: np.ndarray, raw: np.ndarray, ends: np.ndarray, part_of: np.ndarray, shift: np.ndarray, span: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings ``raw[ends[i]:ends[i+1]]`` with a route each; part p is ``span[p]`` windows
    from ``shift[p]`` of string ``part_of[p]`` and occurs ``n[p]`` times. The (part, from,
    to) ranges of its windows that occur twice or more among the strings of one route."""
    if not len(routes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(routes, kind="stable")
    length = np.diff(ends)[order]
    old, piece = spread(ends[:-1][order], length)
    # Symbols: bytes + 2; a 1 between strings of a route, a 0 behind its last.
    new = np.arange(len(old)) + piece
    base = np.concatenate((np.flatnonzero(np.concatenate(([True], np.diff(routes[order]) != 0))), [len(order)]))
    text = np.ones(len(old) + len(order), np.int64)
    text[new] = raw[old] + np.int64(2)
    close = np.cumsum(length + 1) - 1
    text[close[base[1:] - 1]] = 0
    begin = close - length
    bounds = np.append(begin, len(text))[base]
    place = np.empty(len(order), np.int64)
    place[order] = begin
    owner = np.full(len(text), -1, np.int64)
    start, own = spread(place[part_of] + shift, span)
    owner[start] = own
    flat = np.zeros(len(text), np.uint8)
    flat[new] = raw[old]
    sa = suffix_arrays(text, bounds)
    sa = sa[owner[sa] >= 0]  # starts of whole windows: two that agree have no others between them
    line = np.searchsorted(bounds, sa, side="right")
    near = np.zeros(len(sa), bool)
    pair = np.flatnonzero(line[1:] == line[:-1])
    near[pair + 1] = _agree(flat, sa[pair], sa[pair + 1], window)
    group = np.cumsum(~near) - 1
    total = np.zeros(group[-1] + 1 if len(group) else 0, np.int64)
    np.add.at(total, group, n[owner[sa]])
    found = np.sort(sa[total[group] > 1])
    part = owner[found]
    fresh = np.concatenate(([True], (np.diff(found) != 1) | (np.diff(part) != 0))) if len(found) else np.empty(0, bool)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(found)) - 1 if len(head) else head
    zero = (place[part_of] + shift)[part[head]]
    return part[head], found[head] - zero, found[tail] - zero


def _search(shards: DataFrame, window: int, most: int = 2_000_000) -> DataFrame:
    """Per partition, sorted by route: strings of as many routes at once as hold ``most``
    bytes. A segment that occurs once and meets no other on either side of its anchor
    shares no window, and is left out."""

    def run(batches):
        held, size = [], 0

        def settle(rows: pa.Table):
            routes = rows["route"].to_numpy()
            lists = rows["parts"].combine_chunks()
            once = lists.flatten().field("n").to_numpy()[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))[:-1]] == 1
            rows = rows.filter(pa.array(~once | met(routes, rows["left"]) | met(routes, rows["right"])))
            parts, width = rows["parts"].combine_chunks(), rows["data"].combine_chunks()
            raw, ends = string_bytes(width.cast(pa.large_binary()).view(pa.large_string()))
            flat = parts.flatten()
            c1, c2, shift, span, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("c1", "c2", "shift", "span", "n"))
            counts = np.diff(parts.offsets.to_numpy())
            found, a, b = repeated_windows(rows["route"].to_numpy(), raw, ends, np.repeat(np.arange(len(counts)), counts), shift.astype(np.int64), span.astype(np.int64), n, window)
            return pa.RecordBatch.from_arrays([pa.array(c1[found]), pa.array(c2[found]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["c1", "c2", "from", "to"])

        for batch in batches:
            held.append(batch)
            size += batch.column(4).nbytes
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            route = rows["route"].to_numpy()
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on
            if cut:
                yield settle(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(b.column(4).nbytes for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return shards.select("route", "left", "right", "parts", "data").mapInArrow(run, "c1 long, c2 long, from int, to int")


def repeated_ranges(texts: DataFrame, window: int = 200, gram: int = 64, crowd: int = 128, shard_bytes: int = 4_000_000) -> DataFrame:
    """``texts`` (rk, rl, t: two columns that name the row, and its text) to (rk, rl,
    ranges): the byte ranges [from, to) that repeated windows cover. ``gram``, a power of
    two of at least 8, is halved until it fits the window."""
    while gram > max(8, window // 2):
        gram //= 2
    if window < 8:
        raise ValueError("windows of less than eight bytes have no anchor")
    name = ["c1", "c2"]
    with working_tables(texts.sparkSession):
        found = as_table(_occurrences(texts, window, gram), "segments")
        # As a table of its own, so that the join below has two plain sides and a hot anchor can be split.
        again = as_table(found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "anchors-again")
        repeated = as_table(found.join(again, "h"), "segments-again")
        groups = as_table(repeated.groupBy("h", *name).agg(F.count("*").alias("n"), F.min(F.struct("rk", "rl", "first", "last", "lead")).alias("at")), "segments-distinct")
        kinds = groups.groupBy("h").agg(F.count("*").alias("k"))
        lists = groups.join(kinds, "h").groupBy("at.rk", "at.rl").agg(F.collect_list(F.struct("h", *name, "n", "k", F.col("at.first").alias("first"), F.col("at.last").alias("last"), F.col("at.lead").alias("lead"))).alias("list"))
        # One row of those that are repeated in full is enough.
        wanted = texts.join(lists, ["rk", "rl"]).dropDuplicates(["rk", "rl"]).select("t", "list")
        strings = as_table(_strings(wanted, window, gram, crowd), "strings")
        crowds = as_table(strings.filter("crowded").select("data", F.explode("parts").alias("p")).select("data", "p.*"), "crowded-segments")
        every = strings.filter("NOT crowded")
        size = strings.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        shards = every.repartition(max(input_partitions(texts), size // shard_bytes + 1), "route").sortWithinPartitions("route")
        hits = as_table(_search(shards, window), "segment-hits")
        # One row a segment, so that a hot one meets one row.
        flagged = hits.unionByName(_crowded(crowds, window)).groupBy(*name).agg(F.collect_set(F.struct("from", "to")).alias("own"))
        shifted = F.transform("own", lambda x: F.struct((F.col("first") + x["from"]).alias("from"), (F.col("first") + x["to"] + window).alias("to")))
        ranges = repeated.join(flagged, name).select("rk", "rl", shifted.alias("own"))
        # Rows that are repeated in full have one name and the same ranges: a set holds them once.
        return as_table(ranges.groupBy("rk", "rl").agg(F.flatten(F.collect_set("own")).alias("ranges")), "repeated-ranges", keep=True)


def remove_repeats(docs: DataFrame, window: int = 200, text: str = "text", with_bytes: bool = False, gram: int = 64) -> DataFrame:
    """All other columns of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, if
    ``with_bytes``, ``kept``: the bytes left (a span may end inside a character).

    Each byte covered by a window of ``window`` bytes that also starts anywhere else goes,
    at every place; windows are judged on the input and do not cross documents. A null
    text is empty. Repeated rows remove each other's bytes; rows are named by a hash of
    all they hold, so null or repeated keys do no harm; columns named like the new ones
    are replaced."""
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]
    kept = [c for c in docs.columns if c != text and c not in new]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)])
    plain = [f"c{i}" for i in range(len(kept))]  # whatever the names, they meet no working column
    named = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain)], F.col(f"`{text}`").alias("t"), row_hash.alias("rk"), F.coalesce(F.octet_length(text), F.lit(0)).alias("rl"))
    ranges = repeated_ranges(named.select("rk", "rl", "t").filter(F.col("rl") >= window), window, gram)
    kinds = {"kept_sha256": T.StringType(), "kept": T.BinaryType()}
    schema = T.StructType([*docs.select([F.col(f"`{c}`") for c in kept]).schema.fields, *[T.StructField(c, kinds.get(c, T.LongType())) for c in new]])
    width = len(kept)

    def run(batches):
        for batch in batches:
            counts, gone, spans, sha, left = [], [], [], [], []
            for value, cut in zip(batch.column(width), batch.column(width + 1)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                keep, at, runs = [], 0, 0
                if cut.is_valid:
                    stop = -1
                    for a, b in sorted((x["from"], x["to"]) for x in cut.as_py()):
                        runs += a > stop  # touching ranges are one run
                        if a > at:
                            keep.append(raw[at:a])
                        at = stop = max(at, b)
                keep.append(raw[at:])
                out = b"".join(keep)
                counts.append(len(raw))
                gone.append(len(raw) - len(out))
                spans.append(runs)
                sha.append(hashlib.sha256(out).hexdigest())
                if with_bytes:
                    left.append(out)
            cols = [batch.column(c) for c in range(width)] + [pa.array(x, pa.int64()) for x in (counts, gone, spans)] + [pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(left, pa.binary())] if with_bytes else []), schema.names)

    return named.join(ranges, ["rk", "rl"], "left").select(*plain, "t", "ranges").mapInArrow(run, schema)
