"""Vector codes, ranked search and repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pressroom.llm import lexical, lyndon, queries, suffix_dedup, vector_codes

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
CLASH = ["rk", "rl", "t", "c0", "c1", "list", "ranges", "n_bytes", "kept_sha256", "score", "rank", "item", "id", "n", "x", "code", "pos", "part"]


def clashing(df):
    return df.select("*", *[F.lit(-1).alias(c) for c in CLASH]).repartition(5)


# ---------------------------------------------------------------- suffix arrays
def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(200):
        strings = []
        for _ in range(rng.randint(1, 8)):
            s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
            strings.append((s[:3] * rng.randint(1, 9) if rng.random() < 0.3 else s) + [0])
        base = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        want = [b + i for b, s in zip(base.tolist(), strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert lyndon.suffix_arrays(np.array(sum(strings, [])), base).tolist() == want
    assert len(lyndon.suffix_arrays(np.empty(0, np.int64), np.zeros(1, np.int64))) == 0


def spans_by_hand(texts, window):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raws for i in range(len(b) - window + 1))
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()


ODD = [
    None, "", "a" * 1000, "ab" * 500, "x" * 199, "x" * 200, "é" * 300, "z" + "é" * 100, "q" * 200 + "r" + "q" * 199, "q" * 201, "k" * 250, LONG[:5000],
    *(f"{i} left of it, {'the common passage ' * 14}and right of it {i * i}" for i in range(30)),
]


def check_bytes(spark, rows, **how):
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, **how).collect())
    assert got == Counter((k, *x) for (k, _), x in zip(rows, spans_by_hand([t for _, t in rows], how.get("window", 200))))


def test_repeated_bytes(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "k" * 250), (None, None), (7, "Hello " * 60), (7, "Hello " * 60)]
    check_bytes(spark, rows)


def test_repeated_bytes_of_other_widths(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for window in (8, 13, 24):
        check_bytes(spark, rows, window=window)
    with pytest.raises(ValueError):
        check_bytes(spark, rows, window=7)


def test_crowded_anchors_go_by_windows(spark):
    rng = random.Random(9)
    common = "".join(rng.choice("abcdef ") for _ in range(260))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(150)) + common + "".join(rng.choice("uvw") for _ in range(150))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = docs.select(F.col("text").alias("t"), F.xxhash64("doc_id").alias("rk"), F.length("text").alias("rl"))
    few, many = ({(r.rk, i) for r in suffix_dedup.repeated_ranges(named, crowd=c).collect() for x in r.ranges for i in range(x["from"], x["to"])} for c in (4, 1000))
    assert few == many and len(few) >= 40 * 260
    check_bytes(spark, rows)


def test_crowded_blocks_meet_no_group(spark, monkeypatch):
    """Copies of a passage that are different before it, and some inside: their blocks are
    compared as neighbours and joined with no group of blocks."""
    rng, seen = np.random.default_rng(3), []
    passage = rng.integers(97, 123, 600, np.uint8).tobytes().decode()
    rows = [(i, 0, rng.integers(97, 123, 300, np.uint8).tobytes().decode() + (passage if i % 100 else passage[: 150 + i % 7] + "0" + passage[160:])) for i in range(300)]
    plain = suffix_dedup.as_table

    def table(df, name, keep=False):
        seen.append(str(df._jdf.queryExecution().optimizedPlan()))
        return plain(df, name, keep)

    monkeypatch.setattr(suffix_dedup, "as_table", table)
    named = spark.createDataFrame(rows, "rk long, rl int, t string")
    got = {(r.rk, i) for r in suffix_dedup.repeated_ranges(named, crowd=4).collect() for x in r.ranges for i in range(x["from"], x["to"])}
    windows = Counter(t[i : i + 200] for _, _, t in rows for i in range(len(t) - 199))
    assert got == {(k, j) for k, _, t in rows for i in range(len(t) - 199) if windows[t[i : i + 200]] > 1 for j in range(i, i + 200)}
    assert not any(re.search(r"Join .*\bk1#", p) for p in seen)


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_neighbours_over_batches(cut):
    rng = np.random.default_rng(cut)
    rows = sorted((int(k), int(w), i) for i, (k, w) in enumerate(zip(rng.integers(0, 12, 60), rng.integers(0, 4, 60))))
    cols = {"c1": [i for *_, i in rows], "c2": [0] * 60, "b": [0] * 60, "k1": [k for k, *_ in rows], "k2": [0] * 60, "w1": [w or None for _, w, _ in rows], "w2": [w or None for _, w, _ in rows]}
    batches = pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()}).to_batches(max_chunksize=cut)
    got = [r for b in suffix_dedup.judged(iter(batches)) for r in b.to_pylist()]
    kinds, cores = Counter((k, w) for k, w, _ in rows), Counter(k for k, *_ in rows)
    assert {r["c1"] for r in got if r["hit"]} == {i for k, w, i in rows if w and kinds[k, w] > 1}
    assert [r["c1"] for r in got if r["edge"]] == [rows[0][2], rows[-1][2]] and len({r["c1"] for r in got}) == len(got)
    refined = Counter((r["k1"], r["w1"] or r["c1"] + 100) for r in got if r["refine"])
    needed = {(k, w or i + 100) for k, w, i in rows if cores[k] > kinds[k, w] or not w and cores[k] > 1}
    assert needed <= set(refined) and all(cores[k] > 1 or refined[k, w] for k, w in refined)
    if cut == 100:
        assert sum(refined.values()) <= len(needed) + 3


def test_no_bytes(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    one = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "é" * 150)], "doc_id long, text string"), window=200, with_bytes=True).first()
    assert one.n_bytes == 300 and one.n_removed == 300 and bytes(one.kept) == b""


# ---------------------------------------------------------------- ranked search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOWN = {c: c + 32 for c in range(0x41, 0x5B)}


def ranked_by_hand(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(DOWN)))) for i, t in docs]
    total, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    for name, text in items:
        asked = Counter(TERM.findall((text or "").translate(DOWN)))
        scored = []
        for i, b in bags:
            s = 0
            for t, c in asked.items():
                if t in b:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    s += c * w * ((10**9 * b[t]) // (1000 * b[t] + 8 * (25 + (75 * b.total() * total) // length)))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        yield name, [(r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scored)[:k], 1)]


@pytest.mark.parametrize("block_bytes,size,share", [(16_000_000, 8192, 64), (1000, 7, 2)])
def test_ranked_search(spark, block_bytes, size, share):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs += [(9000, None), (9001, ""), (9002, "!! --"), (9003, LONG), (9004, "ÀÉ é_É İ 12 é"), (9005, "w1 W1\x00w1"), (None, "w1 w2"), (None, "w1 w2"), (9006, "w1 w2"), (9006, "w1 w2"), *((9100 + i, "tie of words") for i in range(15))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "..."), (903, "w1 w1 é"), (904, "TIE words nowhereelse"), (905, LONG), (None, "w2 w1"), (903, "w1 w1 é"), (906, "nowhereelse")]
    got = defaultdict(list)
    for r in lexical.rank_documents(clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame(items, "item_id long, text string")), block_bytes=block_bytes, size=size, share=share).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    want = defaultdict(list)
    for name, found in ranked_by_hand(docs, items, 10):
        want[name] += found
    order = lambda x: (x[0], x[1] is None, x[1] or 0, x[2])
    assert {k: sorted(v, key=order) for k, v in got.items()} == {k: sorted(v, key=order) for k, v in want.items() if v}


def test_no_ranked_search(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert lexical.rank_documents(none, items).count() == 0
    assert lexical.rank_documents(some, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical.rank_documents(some, items).first()["doc_id"] == 1


def test_bounds_drop_pairs():
    """Documents of different subjects: most pairs are never scored."""
    rng = np.random.default_rng(1)
    subject = np.repeat(np.arange(40), 50)
    term = np.concatenate([np.sort(rng.choice(10, 4, replace=False)) + 10 * s for s in subject])
    docs = lexical.Sparse(np.arange(0, 4 * len(subject) + 1, 4), term, rng.integers(1, 1000, len(term)))
    items = lexical.Sparse(np.arange(0, 81, 2), np.concatenate([[10 * s, 10 * s + 1] for s in range(40)]), np.ones(80, np.int64))
    search, scored = lexical.Search(items, np.full(400, 7), np.zeros(40, np.int64), 3), []
    inner = search._score
    search._score = lambda node, rows: (scored.append(len(rows) * 8), inner(node, rows))
    search.add(docs, np.arange(len(subject)))
    dense = np.zeros((len(subject), 400), np.int64)
    dense[np.repeat(np.arange(len(subject)), 4), term] = docs.value
    item, ids, score = search.found()
    for q in range(40):
        want = sorted(((-int(s), i) for i, s in enumerate(7 * (dense[:, 10 * q] + dense[:, 10 * q + 1])) if s), key=lambda x: x)[:3]
        assert [(-int(s), int(i)) for s, i in zip(score[item == q], ids[item == q])] == want
    assert sum(scored) < 40 * len(subject) / 3


# ---------------------------------------------------------------- codes
def codes_by_hand(rows, parts, entries, rounds):
    rows = [(k, [math.floor(1024 * x) for x in v], c) for k, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(rows[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in start] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in rows:
                members[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else y for e, y in enumerate(books[p])]
    out, label = [], Counter()
    for k, v, c in rows:
        best = [near(x, b) for x, b in zip(cut(v), books)]
        out.append((k, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), c))
        label[c] += sum(d for d, _ in best)
    name = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return Counter((k, code, e, label[c], name) for k, code, e, c in out)


def test_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) / 4).tolist(), [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(200 + i, rows[3][1], 5) for i in range(40)] + [(3, rows[9][1], 1), (3, rows[9][1], 1), (None, rows[4][1], None), (300, [0.0] * 8, 1), (301, [-1e-9] * 8, 1)]
    bad = [(-1, None, 1), (-2, [None] * 8, 1), (-3, [float("nan")] * 8, None), (-4, [float("inf")] * 8, 1), (9999, [1.0] * 4, 1), (9998, [], 1), (9997, [1.0] * 7, 2), (9996, [1e30] * 8, 1)]
    df = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int"))
    for entries, parts in ((256, 4), (16, 4), (16, 2)):
        got = Counter(tuple(r) for r in vector_codes.encode(df, entries=entries, parts=parts).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
        assert got == codes_by_hand(rows, parts, entries, 4)
    assert vector_codes.encode(spark.createDataFrame(bad[:4], "vec_id long, embedding array<double>, label int")).count() == 0
    assert vector_codes.encode(df.limit(0)).count() == 0


def test_walk_shares_and_falls_back():
    rng = np.random.default_rng(2)
    for most in (3, 1 << 26):
        parts = np.unique(rng.integers(-most, most, (700, 5)), axis=0)
        book = rng.integers(-most, most, (9, 5))
        book[4] = book[2]
        code, far = vector_codes.walk(parts, book, leaves=64)
        want = ((parts[:, None] - book) ** 2).sum(2)
        assert (code == want.argmin(1)).all() and (far == want.min(1)).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(found.fetchall())
