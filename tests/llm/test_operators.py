"""The corpus operators against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns of clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pressroom.llm import bpe, components, embed_dedup, langid, minhash, mixing, sharding, substring, token_counts, token_files, topk  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
#: A Thue-Morse pattern and its complement: polynomial hashes modulo a power of 2 take them for equal.
MORSE = [[(bin(i).count("1") + c) % 2 for i in range(1024)] for c in (0, 1)]
X, Y = ("".join("ab"[k] for k in m) for m in MORSE)
ODD = [
    (9000, None), (9001, ""), (9002, "   \n"), (9003, "a b"), (9004, "A\t b  \r\n c"), (9005, "123 !!"), (9006, LONG),
    (9007, " ".join(["same"] * 80)), (9008, "x <|endoftext|> y<|startoftext|>İΣ it's 12 é ́x   z"),
    (9009, " ".join(f"z{i}" for i in range(35))), (9010, "q " + "\n".join(f"z{i}" for i in range(35)) + " r"),
    (9020, X), (9021, Y), (9022, f"{X} {Y}"), (9023, f"{Y} {X}"), *((9024 + i, " ".join(f"p{k}" for k in range(17)) + f" {w} " + " ".join(f"q{k}" for k in range(17))) for i, w in enumerate((X, Y))),
    *((9030 + i, " ".join(("uv", "wx")[k] for k in m)) for i, m in enumerate(MORSE)), (9032, " ".join(("yz", "yz yy")[k] for k in MORSE[0])),
    (9011, "one two three four five"), (9011, "one two three four five"), (None, "key less text of some words here"), (None, None),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(k, t, None, None) for k, t in ODD], "doc_id long, text string, lang string, source string")
    clash = ["n_tokens", "score", "size", "bucket", "label", "bands", "rk", "ranges", "quality", "u", "shard", "slot", "n_words"]
    return base.unionByName(odd).select("*", *[F.lit(-1).alias(c) for c in clash]).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_token_files(spark, docs, rows, none):
    t = Tokenizer.from_file(token_files.default_path("byte_bpe_50k.json"))
    got = token_files.encode_and_read(docs).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for k, x in rows:
        texts[k].append(t.encode(x or "", add_special_tokens=False).ids + [0])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = next(i for i in texts[r.doc_id] if (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) == (r.n_tokens, r.ids_crc32))
        texts[r.doc_id].remove(ids)
        assert r.start == at
        at += len(ids)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert token_files.encode_and_read(none).count() == 0


def test_one_document_and_damage(tmp_path):
    path = str(tmp_path / "x.zst")
    w = token_files.FrameWriter(open(path, "wb"), 2)
    for k in range(50):
        w.add(k, np.arange(k))
    w.close()
    r = token_files.FrameReader(path)
    assert len(r) == 50 and list(next(r.read(7))) == list(range(7)) and [len(x) for x in r.read(10, 13)] == [10, 11, 12]
    raw = bytearray(open(path, "rb").read())
    raw[int(r.starts[30]) + 12] ^= 0xFF
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        next(token_files.FrameReader(path).read(30))


def test_bpe(docs, rows, none):
    t = Tokenizer.from_file(token_files.default_path("word_bpe_49k.json"))
    got = bpe.encode(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for k, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode(none).count() == 0


def test_token_counts(docs, rows, none):
    t = Tokenizer.from_file(token_files.default_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs).collect())
    assert got == Counter((k, len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in rows)
    assert token_counts.count_tokens(none).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    ids = np.array([9, 9, 0, 0, *[7] * 40, 0, 5], "<u2")
    (tmp_path / "f.ids").write_bytes(ids.tobytes())
    (tmp_path / "empty.ids").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / "f.ids"), len(ids) * 2), (str(tmp_path / "empty.ids"), 0)], "path string, n_bytes long")
    got = sorted((r.ordinal, r.start, r.n_tokens, r.terminated) for r in token_counts.scan(files, 0, 2, block_bytes=7).collect())
    assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 40, True), (3, 45, 1, False)]


def test_language_id(spark, docs, rows, none):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    labels = {r.doc_id: r.lang for r in docs.collect() if r.lang}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.9 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {9000, 9001, 9002, 9005, None}
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "a b")], SCHEMA).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(i, f"x{i % 30}qz w{i % 30}jk v{i % 30}" * 3, f"l{i % 30}") for i in range(300)] + [(1000, "rare words here", "zz")] * 40
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), in_all=64)
    assert sorted(model.names) == sorted({f"l{i}" for i in range(30)} | {"zz"})
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), in_all=20)


def test_short_texts_come_in_bounded_slices():
    parts = list(langid.trigram_vectors(pa.array(["ab"] * 5000)))
    assert max(j - i for i, j, _ in parts) <= 1024 and sum(j - i for i, j, _ in parts) == 5000


def test_prediction_recomputed(docs, rows):
    """Families by the greatest margin, then votes of pairs, on vectors counted letter by letter."""
    model = langid.train(docs)
    got = Counter((r.doc_id, r.lang_pred) for r in langid.predict(docs.select("doc_id", "text"), model).collect())
    want = Counter()
    for k, x in rows:
        if not any(c.isalpha() for c in x or ""):
            want[k, "und"] += 1
            continue
        raw = b" " + bytes(b if 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in x.lower().encode()) + b" "
        raw = re.sub(b" +", b" ", raw)
        v = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            v[((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        v = np.sqrt(v) / np.sqrt(v.sum())
        members = model.families[model.names[int((v @ model.outer[:-1] + model.outer[-1]).argmax())]]
        votes = Counter({0: 0})
        if len(members) > 1:
            pairs, w = model.inner[langid.family_of(members[0])]
            for (a, b), m in zip(pairs, v @ w[:-1] + w[-1]):
                votes[a if m > 0 else b] += 1
        want[k, members[votes.most_common(1)[0][0]]] += 1
    assert got == want


def test_width_and_separator():
    path = token_files.default_path("word_bpe_49k.json")
    assert token_files.added_tokens(path)["<|endoftext|>"] == 49407 and token_files.id_width(path, 49407) == 2
    assert token_files.id_width(path, 70_000) == 4 and token_files.id_width(path, 1, 4) == 4
    with pytest.raises(ValueError):
        token_files.id_width(path, 70_000, 2)


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("pivots", [0, 3])
def test_minhash(spark, docs, rows, none, pivots):
    near = [(9100 + i, " ".join(f"n{j}" for j in range(60) if j != i)) for i in range(12)]
    extra = spark.createDataFrame(near, SCHEMA)
    both = docs.select("doc_id", "text", "label", "bands").unionByName(extra, allowMissingColumns=True)
    got = minhash.near_duplicates(both, words=4, pivots=pivots).collect()
    sets = [(k, shingles(x, 4)) for k, x in rows + near]
    top = {k: k for k, _ in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    want = Counter((k, len(s), root(k), root(k) == k) for k, s in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert minhash.near_duplicates(none).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    a, b = s[:2700], s[300:]
    same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(same - 2400 / 3000) < 0.08


@pytest.mark.parametrize("crowd", [0, 48])
def test_substring(docs, rows, none, crowd, monkeypatch):
    plain = substring.repeated_ranges
    monkeypatch.setattr(substring, "repeated_ranges", lambda t, w=35, g=6: plain(t, w, g, crowd=crowd))
    got = substring.remove_repeats(docs.select("doc_id", "text", "rk", "ranges", "n_words"), with_text=True).collect()
    words = [(k, WORD.findall(x or "")) for k, x in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = Counter()
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == want
    assert substring.remove_repeats(none).count() == 0


def best_shard(key, n):
    """The shard as its definition has it: the greatest -1 / ln(u) of hashes of (key, shard)."""
    first = xxhash.xxh64_intdigest(("\0null" if key is None else str(key)).encode(), 42)
    draw = [(xxhash.xxh64_intdigest(f"shard-{i}".encode(), first) >> 11) + 0.5 for i in range(n)]
    return max(range(n), key=lambda i: (-1 / np.log(draw[i] / (1 << 53)), -i))


@pytest.mark.parametrize("bucket_rows", [1, 200_000])
def test_sharding(docs, rows, none, bucket_rows):
    got = sharding.shard_documents(docs, bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((k, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for k, x in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all((r.shard, r.grown_shard) == (best_shard(r.doc_id, 8), best_shard(r.doc_id, 9)) for r in got)
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    assert sharding.shard_documents(none).count() == 0


def test_shard_weights(spark):
    rows = spark.range(20_000).withColumn("s", sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0]))
    n = Counter(r.s for r in rows.collect())
    assert set(n) == {0, 1} and 0.23 < n[0] / 20_000 < 0.27


def water(sizes, weights, share):
    target = {k: 0.0 for k in sizes}
    free, left = set(sizes), share * sum(sizes.values())
    while free:
        w = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / w > 2 * sizes[k]}
        if not over:
            return target | {k: left * weights[k] / w for k in free}
        for k in over:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
        free -= over
    return target


def test_mixing(spark, docs, rows, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = mixing.mix(docs, mixing.quality_weights(labels), carry=["size", "u"]).collect()
    again = mixing.mix(docs.repartition(3), mixing.quality_weights(labels)).collect()
    pick = lambda rs: Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rs)
    assert pick(got) == pick(again) and len(got) == len(rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, len(WORD.findall(x or ""))) for k, x in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r["size"]
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = water(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5)
    longest = max(r["size"] for r in got)
    for s in names:
        assert abs(want[s] - target[s]) < 1e-3 and abs(taken[s] - target[s]) <= longest / 2 + 1
    assert pick(got) == drawn(rows, source, {r.doc_id: r.quality for r in labels.collect()}, want, size)
    assert mixing.mix(none).count() == 0


def drawn(rows, source, quality, target, total):
    """Whole epochs, then documents by ascending key until the next would mostly miss."""
    out, members = Counter(), defaultdict(list)
    for k, x in rows:
        text = 0 if x is None else xxhash.xxh64_intdigest(x.encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", 0), 42)
        h = xxhash.xxh64_intdigest(("\0null" if k is None else str(k)).encode(), h)
        h = xxhash.xxh64_intdigest(struct.pack("<Q", text), h)
        weight = {None: 1.0, 0: 0.5, 1: 2.0}[quality.get(k)]
        members[source[k]].append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / weight, -1 if k is None else k, len(WORD.findall(x or "")), k))
    for s, docs in members.items():
        epochs = int(target[s] / total[s] + 1e-12) if total[s] else 0
        rest, used = max(0.0, target[s] - epochs * total[s]), 0
        for _, _, n, k in sorted(docs, key=lambda d: d[:3]):
            used += n
            out[k, n, total[s], round(target[s], 6), n * (epochs + (used - n / 2 <= rest))] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    base = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rng = np.random.default_rng(3)
    seed = rng.normal(size=64)
    near = [(8000 + i, [float(x) for x in seed + rng.normal(size=64) * 0.25], 1) for i in range(60)]
    copies = [(8100 + i, [0.5] * 64, 2) for i in range(50)]
    odd = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, [1.0, 2.0], 1), (9004, [1.0, 2.1], 1), (9100, [None] * 64, 3), (9200, [0.1] * 64, None), (9005, [], 2), (None, [0.5] * 64, 2), (9006, [float("inf")] * 64, 2), (9300, [-0.0] * 63 + [1.0], 2)]
    return base.unionByName(spark.createDataFrame(near + copies + odd, VECTORS)).select("*", F.lit(1).alias("rep"), F.lit(1).alias("c")).repartition(5).cache()


@pytest.mark.parametrize("crowd", [8, 4096])
def test_embedding_dedup(spark, vectors, crowd):
    got = embed_dedup.near_vectors(vectors, crowd=crowd).collect()
    rows = vectors.collect()
    ok = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links, top = Counter(), {r.vec_id: r.vec_id for r in rows}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a.vec_id] += 1
                    links[b.vec_id] += 1
                    p, q = sorted((root(a.vec_id), root(b.vec_id)))
                    top[q] = p
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter((r.vec_id, links[r.vec_id], root(r.vec_id), root(r.vec_id) == r.vec_id) for r in rows)
    assert embed_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_repeated_vector_ids_count_by_row(spark):
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0, 0.0]), (6, [1.0, 0.01, 0.0, 0.0]), (7, [0.01, 1.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.01, 0.0]), (9, [0.0, 0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.01, 1.0]), (9, [0.0, 0.0, 0.0, 1.0])]
    got = embed_dedup.near_vectors(spark.createDataFrame([(k, v, 1) for k, v in rows], VECTORS)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter([(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (8, 2, 5, False), (9, 2, 3, False), (9, 2, 3, False), (3, 2, 3, True)])


def test_scopes_of_two_threads(spark):
    import threading

    from pressroom.llm import common

    ready, go, kept = threading.Event(), threading.Event(), {}

    def other():
        with common.working_tables(spark):
            kept["rows"] = common.as_table(spark.range(3), "thread")
            ready.set()
            go.wait(60)
            kept["n"] = kept["rows"].count()

    thread = threading.Thread(target=other)
    with common.working_tables(spark):
        thread.start()
        assert ready.wait(60)
        common.as_table(spark.range(2), "main")
    go.set()
    thread.join()
    assert kept["n"] == 3


@pytest.mark.parametrize("block", [40, 4096])
def test_top_k(spark, vectors, block):
    twice = vectors.unionByName(vectors.filter("vec_id in (100, 200, 8100, 7)")).unionByName(vectors.filter("vec_id = 300").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(twice, block=block, queries=2, centres=9).collect())
    ok = [r for r in twice.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    want = Counter()
    whole = [(r.vec_id, np.floor(1024 * np.array(r.embedding, float)).astype(np.int64)) for r in ok]
    for i, (q, u) in enumerate(whole):
        if q % 100 == 0:
            best = sorted((-int(u @ v), k) for j, (k, v) in enumerate(whole) if j != i and len(v) == len(u))[:10]
            want.update((q, n, k, -s) for n, (s, k) in enumerate(best, 1))
    assert got == want
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(0).normal(size=(500, 8))
    stack = [topk.cover_tree(x, np.arange(500), leaf=8)]
    while stack:
        n = stack.pop()
        assert np.sqrt(((x[n.points] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        if n.children:
            assert n.radius <= 1.3**n.level
            assert sorted(np.concatenate([c.points for c in n.children])) == sorted(n.points)
            inner = [c.centre for c in n.children if c.children]
            for i, c in enumerate(inner):
                assert all(np.sqrt(((c - o) ** 2).sum()) > 1.3 ** (n.level - 1) * (1 - 1e-9) for o in inner[:i])
        stack += n.children


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 100), (5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100: 90}
