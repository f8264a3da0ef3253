"""Removal of word passages that stand at more than one place of the corpus.

Every window of consecutive words has one anchor: its least k-gram by hash, the
leftmost of equals. Consecutive windows with one anchor make a segment. Windows of
equal words have equal anchors, so only segments whose anchor occurs again can hold a
repeated window, and segments of one anchor go to one shard. There an FM-index over the
distinct segments, weighted by how often each occurs, is searched with the segments
themselves. An anchor with many different segments (the edge of a passage that a large
part of the corpus shares) is dealt by whole windows instead, equal ones added up first."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Runs, as_table, input_partitions, mix, slices, string_bytes, word_hashes, word_numbers, word_spans, working_tables
from .fm_index import FMIndex

_PLACE = np.uint64((1 << 28) - 1)


def segments(runs: Runs, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last window start (positions in the word sequence behind
    ``runs``) of every segment. ``owner`` is the text of each word."""
    n, span = len(owner), window - gram + 1
    start = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :]) if n >= window else np.empty(0, np.int64)
    if not len(start):
        return np.empty(0, np.uint64), start, start
    at = np.arange(n - gram + 1)
    grams = runs.hashes(at, gram)
    least = (mix(grams) & ~_PLACE) | at.astype(np.uint64)
    have = 1
    while have < span:  # minimum over `have` places, doubled until it covers the window
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    head = np.flatnonzero(new)
    return grams[anchor[head]], start[head], start[np.append(head[1:], len(start)) - 1]


def _occurrences(texts: DataFrame, window: int, gram: int, most: int = 1_000_000) -> DataFrame:
    """Anchor (h) and name of the words (content) of every segment; the two come from
    independent hashes of the words."""

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(2))
            for i, j in slices(offsets, most):
                part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, owner = word_spans(part, offs)
                h, first, last = segments(Runs(word_hashes(part, starts, ends)), owner, window, gram)
                if not len(h):
                    continue
                content = Runs(word_hashes(part, starts, ends, 1)).hashes(first, last - first + window)
                bounds, text = np.searchsorted(owner, np.arange(len(offs))), owner[first]
                rows = pa.array(text + i)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((first - bounds[text]).astype(np.int32)), pa.array((last - bounds[text]).astype(np.int32))], ["h", "content", "rk", "rl", "first", "last"])

    return texts.select("rk", "rl", "t").mapInArrow(run, "h long, content long, rk long, rl int, first int, last int")


def _contents(wanted: DataFrame, window: int, most: int = 1_000_000) -> DataFrame:
    """The words of the wanted segments of each text; those of crowded anchors cut into
    their windows, with a hash of the window as the place to go to and another as tag."""
    names = ["route", "tag", "h", "content", "shift", "n", "words"]

    def run(batches):
        for batch in batches:
            data, offsets = string_bytes(batch.column(0))
            lists = batch.column(1)
            for i, j in slices(offsets, most):
                part = data[offsets[i] : offsets[j]]
                starts, ends, owner = word_spans(part, offsets[i : j + 1] - offsets[i])
                bounds = np.searchsorted(owner, np.arange(j - i + 1))
                raw, runs = part.tobytes(), None
                out = [[] for _ in names]
                for k in range(i, j):
                    base = int(bounds[k - i])
                    for s in lists[k].as_py():
                        a, b = base + s["first"], base + s["last"]
                        if not s["crowded"]:
                            for c, v in zip(out, (s["h"], s["content"], s["h"], s["content"], -1, s["n"], raw[starts[a] : ends[b + window - 1]])):
                                c.append(v)
                            continue
                        at = np.arange(a, b + 1)
                        runs = runs or [Runs(word_hashes(part, starts, ends, seed)) for seed in (0, 1)]
                        for w, tag, p in zip(*(r.hashes(at, window).view(np.int64).tolist() for r in runs), at.tolist()):
                            for c, v in zip(out, (w, tag, s["h"], s["content"], p - a, s["n"], raw[starts[p] : ends[p + window - 1]])):
                                c.append(v)
                if out[0]:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return wanted.mapInArrow(run, "route long, tag long, h long, content long, shift int, n long, words binary")


def _search(shards: DataFrame, window: int) -> DataFrame:
    """One FM-index per partition: the ranges of window starts (from, to), counted from
    the segment's first word, whose words stand at two places or more. Words are
    numbered by their bytes, so what the index finds equal is equal."""

    def run(batches):
        keys, weights, parts = [], [], []
        for batch in batches:
            keys.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1))
            weights.append(batch.column(2).to_numpy())
            parts.append(string_bytes(batch.column(3).cast(pa.large_binary()).view(pa.large_string())))
        if not any(len(d) for d, _ in parts):
            return
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        data = np.concatenate([d for d, _ in parts])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))))
        del parts
        starts, ends, owner = word_spans(data, offsets)
        length = np.bincount(owner, minlength=len(keys))
        # Numbers from 1 up for words; 0 between segments, which no pattern holds.
        first = np.cumsum(length + 1) - length - 1
        text = np.zeros(len(owner) + len(keys), np.int64)
        own = np.arange(len(owner)) + owner
        text[own] = word_numbers(data, starts, ends) + 1
        weight = np.zeros(len(text), np.int64)
        weight[own] = weights[owner]
        del data, starts, ends, own
        found = FMIndex(text, window, weight, 2).windows(text, first, length)
        edge = np.diff(np.concatenate(([0], found.astype(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        seg = np.searchsorted(first, start, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[seg, 0]), pa.array(keys[seg, 1]), pa.array((start - first[seg]).astype(np.int32)), pa.array((stop - 1 - first[seg]).astype(np.int32))], ["route", "tag", "from", "to"])

    return shards.mapInArrow(run, "route long, tag long, from int, to int")


def repeated_ranges(texts: DataFrame, window: int = 35, gram: int = 6, crowd: int = 48, shard_bytes: int = 2_500_000) -> DataFrame:
    """``texts`` (rk, rl, t: two columns that name the row, and its text) to (rk, rl,
    ranges): the word ranges [from, to) that repeated windows cover."""
    with working_tables(texts.sparkSession):
        found = as_table(_occurrences(texts, window, gram), "segments")
        # As a table of its own, so that the join below has two plain sides and a hot anchor can be split.
        again = as_table(found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "anchors-again")
        repeated = as_table(found.join(again, "h"), "segments-again")
        groups = repeated.groupBy("h", "content").agg(F.count("*").alias("n"), F.min(F.struct("rk", "rl", "first", "last")).alias("at"))
        kinds = repeated.select("h", "content").distinct().groupBy("h").agg((F.count("*") > crowd).alias("crowded"))
        lists = groups.join(kinds, "h").groupBy("at.rk", "at.rl").agg(F.collect_list(F.struct("h", "content", "n", "crowded", F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("list"))
        wanted = texts.join(lists, ["rk", "rl"]).select("t", "list")
        pieces = as_table(_contents(wanted, window), "segment-words")
        size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        merged = pieces.groupBy("route", "tag").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
        shards = merged.select("route", "tag", "n", "words").repartition(max(input_partitions(texts), size // shard_bytes + 1), "route")
        hits = as_table(_search(shards, window), "segment-hits")
        light = pieces.filter("shift < 0").select("route", "tag", "h", "content").join(hits, ["route", "tag"]).select("h", "content", "from", "to")
        heavy = pieces.filter("shift >= 0").select("route", "tag", "h", "content", "shift").join(hits.select("route", "tag"), ["route", "tag"]).select("h", "content", F.col("shift").alias("from"), F.col("shift").alias("to"))
        ranges = repeated.join(light.unionByName(heavy).distinct(), ["h", "content"]).select("rk", "rl", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + window).alias("to"))
        # Rows that are repeated in full have one name and the same ranges: a set holds them once.
        return as_table(ranges.groupBy("rk", "rl").agg(F.collect_set(F.struct("from", "to")).alias("ranges")), "repeated-ranges", keep=True)


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", with_text: bool = False, gram: int = 6) -> DataFrame:
    """All other columns of ``docs`` with n_words, n_removed, kept_sha256 and, if
    ``with_text``, the text left: the kept words joined by one blank.

    Each word covered by a repeated window goes, at every place; windows are judged on
    the input. Null and empty texts have no words; a null text becomes empty. Repeated
    rows remove each other's words; rows are named by a hash of all they hold, so null or
    repeated keys do no harm; columns named like the new ones are replaced."""
    new = ["n_words", "n_removed", "kept_sha256"]
    kept = [c for c in docs.columns if c != text and c not in new]
    spark_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)])
    plain = [f"c{i}" for i in range(len(kept))]  # whatever the names, they meet no working column
    named = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain)], F.col(f"`{text}`").alias("t"), spark_hash.alias("rk"), F.coalesce(F.octet_length(text), F.lit(0)).alias("rl"))
    ranges = repeated_ranges(named.select("rk", "rl", "t").filter("rl > 0"), window, gram)
    schema = T.StructType([*docs.select([F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField(text, T.StringType())] if with_text else [])])
    width = len(kept)

    def run(batches):
        for batch in batches:
            counts, gone, sha, left = [], [], [], []
            for value, cut in zip(batch.column(width), batch.column(width + 1)):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                total = len(words)
                if cut.is_valid:
                    keep, at = [], 0
                    for a, b in sorted((x["from"], x["to"]) for x in cut.as_py()):
                        if a > at:
                            keep += words[at:a]
                        at = max(at, b)
                    words = keep + words[at:]
                out = b" ".join(words)
                counts.append(total)
                gone.append(total - len(words))
                sha.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    left.append(out.decode("utf-8", "replace"))
            cols = [batch.column(c) for c in range(width)] + [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(left, pa.string())] if with_text else []), schema.names)

    joined = named.join(ranges, ["rk", "rl"], "left")
    return joined.select(*plain, "t", "ranges").mapInArrow(run, schema)
