"""The pipeline's stages on a small table, the rows of each against brute force on its
own input."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SMALL

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import WORD, drawn, shingles, water  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from pressroom.llm import langid, token_files  # noqa: E402

COLUMNS = corpus_pipeline.COLUMNS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def languages(spark, docs):
    predicted = {(r.doc_id, r.text): r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    return Counter({(k, x, predicted[k, x], s, n): c for (k, x, _, s, n), c in rows_of(docs).items() if any(ch.isalpha() for ch in x or "")})


def without_copies(docs):
    rows = rows_of(docs)
    sets = [(k, shingles(x, 5)) for k, x, *_ in rows]
    top = {k: k for k, _ in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if len(s) and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return Counter({r: c for r, c in rows.items() if root(r[0]) == r[0]})


def without_passages(docs):
    rows = rows_of(docs)
    words = {r: WORD.findall(r[1]) for r in rows}
    seen = Counter()
    for r, c in rows.items():
        for i in range(len(words[r]) - 34):
            seen[tuple(words[r][i : i + 35])] += c
    out = Counter()
    for (k, x, lang, s, n), c in rows.items():
        w = words[k, x, lang, s, n]
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        left = " ".join(y for i, y in enumerate(w) if i not in gone)
        if left:
            out[k, left, lang, s, len(left)] += c
    return out


def mixed(spark, docs):
    rows = rows_of(docs)
    size = Counter()
    for (k, x, _, s, _), c in rows.items():
        size[s] += c * len(WORD.findall(x))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    target = water(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    each = [(r[0], r[1]) for r in rows.elements()]
    taken = {k: t // n for k, n, _, _, t in drawn(each, {r[0]: r[3] for r in rows}, quality, target, size) if n}
    return Counter({r: c * taken[r[0]] for r, c in rows.items() if taken.get(r[0])})


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*COLUMNS)
    passage = " ".join(f"passage{i}" for i in range(60))
    odd = [(9000, None, None, None, None), (9001, "12 !!", None, "src0", 5), (9002, "the and " * 30, "en", None, 240), (9003, "the and " * 30, "en", "s", 240), (9004, passage, "en", "s", 600), (9005, f"head {passage} tail", "en", "s", 600), (9006, "", "en", "s", 0)]
    now, expected = docs.unionByName(spark.createDataFrame(odd, SCHEMA)), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        expected = {"language ID": lambda d: languages(spark, d), "MinHash near-dedup": without_copies, "substring dedup": without_passages, "mixing": lambda d: mixed(spark, d)}.get(name)
        want = expected(now) if expected else None
        stage(spark, now, SMALL).write.parquet(path)
        before, now = now, spark.read.parquet(path)
        if want is not None:
            assert now.columns == COLUMNS, name
            assert rows_of(now) == want, name
            assert sum(want.values()) > 0
    t = Tokenizer.from_file(token_files.default_path("word_bpe_49k.json"))
    ids = Counter((r.doc_id, tuple(t.encode(r.text, add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in now.collect()) == ids


def test_repeated_rows_stand_or_fall_together(spark):
    rows = [(1, "one two three four five six", "en", "s", 28)] * 3 + [(2, "one two three four five six", "en", "s", 28), (None, "key less words", "en", None, 14)]
    got = rows_of(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), SMALL))
    assert got == Counter({rows[0]: 3, rows[-1]: 1})


def test_empty_table(spark, tmp_path):
    now = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        assert now.count() == 0, name
        if name != "BPE":
            assert now.columns == COLUMNS
