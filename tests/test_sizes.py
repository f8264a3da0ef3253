"""Steps that must hold on larger tables: what is sent to all tasks, how many rows meet,
and SQL whose constants or rounding fit small data only."""

from __future__ import annotations

import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from pressroom import catalog
from pressroom.functions import text
from pressroom.operators import board, library, search, timeline


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_words_are_not_broadcast(spark):
    tokens = board.stored(spark.createDataFrame([(1, "heron", 2), (2, "herons", 1)], "k long, token string, weight int"))
    asked = spark.createDataFrame([(7, 1, "heron")], "q long, n int, qt string")
    best, seen = search.best_hits(tokens, asked, "k", 1, 3)
    assert sorted(tuple(r) for r in best.collect()) == [(1, "heron", 6), (2, "heron", 2)]
    assert "BroadcastExchange" not in plan(best) + plan(seen)


def test_soft_sums_without_a_shuffle_of_pairs(spark):
    assets = spark.createDataFrame([(1, "heron", "grey bird", "water"), (2, "stork", "bird", "")], "k long, subject string, labels string, description string")
    asked = spark.createDataFrame([(7, "heron bird"), (8, "stork")], "q long, t string")
    rarity = spark.createDataFrame([("bird", 0.5)], "token string, weight double")
    few, many = (search.soft(assets, asked, rarity, "k", "q", "t", few=n) for n in (1_000_000, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(7, 1, 24.0), (7, 2, 4.5), (8, 2, 18.0)]
    assert "hashpartitioning(q" not in plan(few)


def test_shared_tokens_sends_no_exploded_sets(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "a long, w array<string>")
    right = spark.createDataFrame([(5, ["a", "b", "z"]), (6, ["x", "y"])], "b long, w array<string>")
    by_share = search.shared_tokens(left, right, "a", "b", "w", 0.5)
    assert sorted(tuple(r) for r in by_share.collect()) == [(1, 5, 2), (2, 6, 1)]
    assert [tuple(r) for r in search.shared_tokens(left, right, "a", "b", "w", 2).collect()] == [(1, 5, 2)]
    assert "BroadcastExchange" not in plan(by_share)


def test_order_of_books_at_large_ids(spark, tmp_path):
    rows = [(3_000_000, 1, "view", '{"k": 1}'), (5, 1, "click", '{"k": 2}'), (2_500_000, 1, "signup", '{"k": 3}')]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    events = pa.Table.from_pylist([dict(zip(df.columns, r)) for r in rows])
    con = duckdb.connect()
    con.register("events", events)
    for name in ("j26_provenance_merge", "w11_candidate_merge"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        found = con.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, found.fetchall()))


def test_colours_are_binned_in_double(spark, tmp_path):
    x = -1e-9  # one more is 1.0 in single precision
    spark.createDataFrame([(1, [x, x, 0.5, -0.5, 0.1, 0.9, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    (got,) = catalog.QUERIES["a20_colour_share"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert con.execute(catalog.ORACLE_SQL["a20_colour_share"]).fetchall() == [tuple(got)]


def test_short_hashes_are_cut_where_they_vary(spark):
    rows = spark.createDataFrame([(i, i * 2654435761 % 2**31) for i in range(400)], "k long, h long")
    most = library.agreeing(rows, "k", "h", 5).groupBy("band", "value").count().agg({"count": "max"}).first()[0]
    assert most < 40
    got = {(r.a, r.b) for r in library.hamming_matches(rows, "k", "h", 5).collect()}
    hashes = {i: i * 2654435761 % 2**31 for i in range(400)}
    assert got == {(a, b) for a in hashes for b in hashes if a < b and hashes[a] != hashes[b] and bin(hashes[a] ^ hashes[b]).count("1") <= 5}


def test_names_meet_on_all_their_words(spark):
    """Frequent words do not bring all names with them together."""
    from itertools import product

    names = [" ".join(w) for w in product("abcdef", "ghijkl", "mnopqr")] + ["a g", "a", "zz", "x a y g z m", " ".join(f"v{i}" for i in range(15)), "v3 v9", "v9 v3", "a a", "a b a"]
    df = spark.createDataFrame([(n,) for n in names], "fold string")
    met = [tuple(r) for r in library.meeting(df, df.select(df.fold.alias("other"))).collect()]
    assert len(met) < 4 * len(names)  # on the rarest word alone: 36 to 216 for each
    inside = {(a, b) for a in names for b in names if set(a.split()) <= set(b.split())}
    assert inside <= set(met)


def test_first_words_need_no_whole_text(spark):
    texts = ["one Two thrée four", "a", "", None, "-- x" + "-" * 500 + "y z w", "é" * 600 + " b c d", "  Đa\u0301 İx  K z", "w " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n, head in ((1, 400), (3, 400), (3, 5)):
        got = df.select(text.first_words(df.t, n, head).alias("got"), F.slice(F.split(text.fold_match(df.t), " "), 1, n).alias("want")).collect()
        assert all(r.got == r.want for r in got)


def test_folds_with_and_without_marks(spark):
    rows = [("Đội tuyển -- Việt Nam!", "doi tuyen    viet nam", "doi-tuyen-viet-nam"), ("Plain, ASCII", "plain  ascii", "plain-ascii"), ("é--" + "x" * 60, "e  " + "x" * 60, "e-" + "x" * 40), ("--", "", ""), (None, None, None)]
    df = spark.createDataFrame([r[:1] for r in rows], "t string")
    got = df.select(text.fold_name(df.t), text.slug(df.t)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]
    shared = df.select(text.fold_match(df.t).alias("match"), text.slug(df.t).alias("slug"))
    assert 'a-z0-9]+, -' not in shared._jdf.queryExecution().optimizedPlan().toString()  # one pass for both


def test_feed_sql_decodes_entities():
    titles = {0: "&quot;a&quot; &amp; b", 1: "&amp;amp;lt;", 2: "&#65;&#x42;c &bogus; &#xD800;", 3: "&eacute;t&nbsp;\u00e9", 4: " ", 5: "plain & bare"}
    pages = pa.Table.from_pylist([{"page_id": k, "html": f"<html><title>{x}</title></html>"} for k, x in titles.items()])
    con = duckdb.connect()
    con.register("pages", pages)
    want = [(0, '"a" & b'), (1, "<"), (2, "ABc &bogus; \ufffd"), (3, "\u00e9t \u00e9"), (5, "plain & bare")]
    assert sorted(con.execute(catalog.ORACLE_SQL["src3_read_feed"]).fetchall()) == want


def test_missing_keys_meet_once(spark):
    ledger = spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 3, None)], "k long")
    files = spark.createDataFrame([(k,) for k in (2, 3, 4, 4, None, None)], "k long")
    got = library.missing_both_ways(ledger, files, "k")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(1, 'no file')", "(4, 'no row')", "(None, 'no file')", "(None, 'no row')"]
    assert "Join" not in plan(got) and "Sort" not in plan(got)


def test_pacing_takes_many_videos_a_batch(spark):
    """A call for each video, not for each batch of them, took most of the time."""
    script = [(10.3, False, 2), (1.0, False, 0), (9.2, True, 2), (12.0, True, 0), (2.4, False, 0), (1.0, False, 0), (6.0, False, 0)]
    rows = [(v, i, *script[i]) for i in reversed(range(7)) for v in range(300)]
    got = timeline.pace(spark.createDataFrame(rows, "v long, i long, length double, is_clip boolean, extra int"), "v", "i")
    want = [(3, 8.8), (1, 2.5), (3, 9.2), (1, 12.0), (1, 2.4), (1, 2.0), (2, 5.0)]
    assert sorted(tuple(r) for r in got.collect()) == [(v, i, *want[i]) for v in range(300) for i in range(7)]
    assert "FlatMapGroupsInPandas" not in plan(got)


def test_labels_are_cleaned_within_their_row(spark):
    many = [f" W{i * 7 % 40}{'!' * (i % 3)}" for i in range(500)]
    rows = {1: ["Cúp", " cup ", "", None, "Goal", "CUP!", "đội", "Doi"], 2: [" ", None], 3: None, 4: many, 5: ["!", "?", "b", "a"]}
    got = library.label_hygiene(spark.createDataFrame(list(rows.items()), "k long, l array<string>"), "k", "l")
    assert {r.k: r.labels for r in got.collect()} == {1: ["Cúp", "Goal", "đội"], 4: [x.strip() for x in many[:12]], 5: ["!", "b", "a"]}
    assert "Exchange" not in plan(got) and "Sort " not in plan(got)


def test_copies_of_a_picture_are_linked(spark, tmp_path):
    """Equal hashes meet the threshold too: each copy is linked to the first."""
    up, down = [float(i) for i in range(64)], [float(-i) for i in range(64)]
    near = [-1.0 if i == 0 else x for i, x in enumerate(down)]  # one bit from ``down``
    vectors = {3: up, 1: down, 7: up, 9: down, 4: near, 8: up, 2: None}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["j6_image_dedupe"](spark, str(tmp_path)).collect())
    assert got == [(1, 4, 1), (1, 9, 0), (3, 7, 0), (3, 8, 0)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet' WHERE embedding IS NOT NULL")
    assert sorted(con.execute(catalog.ORACLE_SQL["j6_image_dedupe"]).fetchall()) == got


def test_best_hit_at_large_ids(spark, tmp_path):
    """A point of score weighs as much as 100,000 in doc_id, as the SQL has it."""
    docs = [(5, "heron", "src"), (350_005, "heron", "heron"), (99_000, "stork", "stork"), (3, "stork", "src"), (4, "stork", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "heron"), (7, "stork"), (8, "quagga")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("u4_rich_thin", "u4_rich_thin_whole"):
        got = {(r.item_id, r.hits, r.kind, r.doc_id) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {(2, 2, "thin", 5), (7, 3, "rich", 99_000), (8, 0, "thin", None)}
        found = con.execute(catalog.ORACLE_SQL[name])
        at = [[c[0] for c in found.description].index(c) for c in ("item_id", "hits", "kind", "doc_id")]
        assert {tuple(r[i] for i in at) for r in found.fetchall()} == got


def test_learned_bonus_lays_out_its_pairs_last(spark):
    """No row for a query and an asset is shuffled or gathered; kinds stand for assets."""
    r = random.Random(4)
    some = lambda letters, n: r.sample(letters, r.randint(0, n))
    asks = {i: some("abcdefgh", 5) for i in range(12)}
    past = [(i, r.choice(["s", "t", "u", None]), some("klmno", 4), some("abcdefgh", 5)) for i in range(9)]
    assets = [(r.randint(0, 30), r.choice(["s", "t", "v", None]), some("klmnp", 4)) for _ in range(45)]  # keys repeat
    want = {}
    for i, words in asks.items():
        for _, subject, labels, tokens in past:
            o = len({*words} & {*tokens})
            for k, own, tags in assets if o >= 2 else ():
                shared = len({*labels} & {*tags})
                bonus = o + 6 if own and own == subject else min(shared, 3) + 2 if shared and own != subject else 0
                want[i, k] = max(bonus, want.get((i, k), 0))
    q = spark.createDataFrame(list(asks.items()), "q long, tokens array<string>")
    h = spark.createDataFrame(past, "past long, subject string, labels array<string>, tokens array<string>")
    a = spark.createDataFrame(assets, "k long, subject string, labels array<string>")
    for few in (0, 1000):
        got = search.learned_label_bonus(q, h, a, "q", "k", few=few, chunk=2, deals=3)
        assert sorted(tuple(x) for x in got.collect()) == sorted((*at, n) for at, n in want.items() if n)
        assert not re.search(r"hashpartitioning\(q#\d+L?, k#", plan(got))


def test_a_common_passage_is_scanned_in_batches(spark):
    """Pairs and clusters of sets that share seven words, in small blocks and batches, are
    those of a plain scan; the pairs inside a large cluster are not made for the scan."""
    r = random.Random(7)
    line, rest = [f"line{i}" for i in range(7)], [f"w{i}" for i in range(60)]
    sets = {3 * i: sorted({*(line if i % 2 else []), *r.sample(rest, r.randint(1, 9))}) for i in range(240)}
    match = lambda a, b: (o := len({*a} & {*b})) >= 3 and o >= 0.5 * min(len(a), len(b))
    items = spark.createDataFrame(list(sets.items()), "k long, s array<string>")
    want = sorted((a, b, len({*sets[a]} & {*sets[b]})) for a in sets for b in sets if a < b and match(sets[a], sets[b]))
    assert sorted(tuple(x) for x in board.overlap_pairs(items, "k", "s", block=5).collect()) == want
    founders, of = [], {}
    for k, s in sets.items():
        of[k] = next((f for f in founders if match(sets[f], s)), k)
        founders += [k] if of[k] == k else []
    seen, leaders = [], board.leaders
    board.leaders = lambda edges: leaders(seen.append(edges.count()) or edges)
    try:
        got = board.clusters(items, "k", "s", batch=16, grow=3, block=5)
        assert {x.k: x.founder for x in got.collect()} == of
    finally:
        board.leaders = leaders
    assert sum(seen) < len(want) / 10


def test_strict_search_compares_few_assets_whole(spark, monkeypatch):
    """Points of every word in every asset are neither stored nor shuffled, and an asset
    without a subject has its other words."""
    r = random.Random(2)
    words = ["a", "of", "heron", "herons", "stork", "storks", "marsh", "reed", "reeds", "bird", "water", "late"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i % 55, r.choice([None, "", text(2)]), text(3), r.choice([None, text(9)])) for i in range(60)]  # keys repeat
    asks = {q: text(1 + q % 7) for q in range(30)}

    def hit(a, b):
        near = {w[:i] + w[i + 1 :] for w in (a, b) for i in range(len(w))} | {a, b}
        one = abs(len(a) - len(b)) == 1 and (a in near and b in near) and ({a[:i] + a[i + 1 :] for i in range(len(a))} | {b[:i] + b[i + 1 :] for i in range(len(b))}) & {a, b}
        typo = one or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1)
        return 3 if a == b else 2 if a in b else 1 if len(a) >= 3 and len(b) >= 3 and typo else 0

    want = {}
    for q, ask in asks.items():
        for k in {row[0] for row in rows}:
            best = [max(hit(w, t) * n for row in rows if row[0] == k for f, n in zip(row[1:], (3, 2, 1)) for t in (f or "").split() or [""]) for w in {*ask.split()}]
            if all(best):
                want[q, k] = sum(best)
    assets = spark.createDataFrame(rows, "k long, subject string, labels string, description string")
    queries = spark.createDataFrame(list(asks.items()), "q long, t string")
    kept, stored, complete = [], search.stored, search._complete
    monkeypatch.setattr(search, "stored", lambda df: kept.append(df.columns) or stored(df))
    assert {(x.q, x.k): x.score for x in search.strict(assets, queries, "k", "q", "t").collect()} == want
    assert ["k", "qt", "points"] not in kept
    monkeypatch.setattr(search, "_complete", lambda *a: complete(*a, first=1, tried=2, few=0))
    assert {(x.q, x.k): x.score for x in search.strict(assets, queries, "k", "q", "t").collect()} == want


def test_first_matches_end_the_search(spark, monkeypatch):
    """Rows that have their three matches meet no later batch."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    left = {a: r.sample(words, r.randint(0, 12)) for a in range(40)}
    right = {b: r.sample(words, r.randint(0, 5)) if b % 4 else words[:3] for b in range(0, 600, 2)}
    fits = lambda t, s: len({*t} & {*s}) > 0 and len({*t} & {*s}) >= 0.35 * len(s)
    want = sorted((a, b, i + 1) for a, t in left.items() for i, b in enumerate([b for b, s in sorted(right.items()) if fits(t, s)][:3]))
    asked, shared = [], search.shared_tokens
    monkeypatch.setattr(search, "shared_tokens", lambda x, *y: asked.append(x.count()) or shared(x, *y))
    schema = "w array<string>"
    got = search.first_shared(spark.createDataFrame(list(left.items()), f"a long, {schema}"), spark.createDataFrame(list(right.items()), f"b long, {schema}"), "a", "b", "w", 0.35, batch=40, grow=2)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert asked[0] == 40 and max(asked[1:]) < 20
