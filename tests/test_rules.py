"""Hand-made rows for the rules that the driver's tables do not reach."""

from __future__ import annotations

import html
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pressroom import catalog
from pressroom.functions import text as tx
from pressroom.operators import board, ledgers, library, search, timeline
from pressroom.sources import readers


def value(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


def test_folds_differ_in_the_barred_d(spark):
    assert value(spark, tx.fold_radar, "Đình Bắc!", None) == [" inh bac ", None]
    assert value(spark, tx.fold_name, "Đình  Bắc!") == ["dinh  bac"]
    assert value(spark, tx.fold_keep, "Đình Bắc!") == ["dinh bac!"]
    assert value(spark, tx.fold_match, " Đình -- Bắc ") == ["dinh bac"]
    assert value(spark, tx.slug, "Đình Bắc!!", "") == ["dinh-bac", ""]


def test_clean_text_decodes_twice(spark):
    assert value(spark, tx.clean_text, "a &amp;apos;b&amp;apos; <b>c</b>", "") == ["a 'b' c", ""]


def test_sentences_keep_domains(spark):
    assert value(spark, tx.sentences, "One. Two! Net stays. Com it") == [["One.", "Two! Net stays. Com it"]]


def test_years(spark):
    q = "champions of 2008, 2018, 2024"
    assert value(spark, tx.one_year, q, "no year", "in 2018") == ["champions of 2024", "no year", "in 2018"]
    made = value(spark, lambda c: tx.queries_per_year(c, F.lit("cup"), F.array().cast("array<string>")), q)
    assert made == [["cup 2008", "cup 2018", "cup 2024"]]
    given = F.array(F.lit("a 2008"), F.lit("a 2018"))
    assert value(spark, lambda c: tx.queries_per_year(c, F.lit("cup"), given), q) == [["a 2008", "a 2018"]]


def test_feed_times(spark):
    texts = ["Mon, 01 Jan 2024 07:00:00 +0700", "01 Jan 2024 00:00:00 GMT", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "soon", None]
    got = value(spark, lambda c: tx.age_hours(tx.feed_time(c), F.lit("2024-01-01 06:00:00").cast("timestamp")), *texts)
    assert got == [6.0, 6.0, 6.0, 6.0, 999.0, 999.0]


def test_tags_stop_at_the_first_overflow(spark):
    text = "Sân PVF / san pvf; Tuyển|" + "x" * 50 + ";" + "y" * 50 + ";short"
    (tags,) = value(spark, lambda c: tx.tag_list(c, 100), text)
    assert tags == ["Sân PVF", "san pvf", "Tuyển", "tuyen", "x" * 50]


def test_proper_names(spark):
    assert value(spark, lambda c: tx.proper_runs(c, ["the"]), "Today Nguyen Quang Hai, met The Coach of Hanoi.") == [["Nguyen Quang Hai", "Coach", "Hanoi"]]


def test_proper_names_of_a_very_long_text(spark):
    text = "a " * 100001 + "b Hanoi"
    assert value(spark, lambda c: tx.proper_runs(c, ["the"]), text, "", None) == [["Hanoi"], [], None]


def test_clip_codes(spark):
    got = value(spark, tx.clip_code, "clip::a.mp4::1::2.5::0,0,1,1", "clip::a.mp4::1::2::x", "clip::a.mp4::1", None)
    assert got[0].frame == [0.0, 0.0, 1.0, 1.0] and got[1].frame is None and got[2] is None and got[3] is None


@pytest.mark.parametrize("a, b, same", [("thanh long", "le pham thanh long", True), ("quang vinh", "do vinh quang", False), ("u23 viet nam", "viet nam", False)])
def test_mergeable_names(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    assert row.select(library.mergeable(F.col("a"), F.col("b"), ["u23"])).first()[0] is same


def test_merge_names_attaches_to_the_first_kept(spark):
    names = spark.createDataFrame([("Le Pham Thanh Long", 9), ("thanh long", 2), ("Thành Long", 1), ("a, b", 5)], "name string, n long")
    got = {r.name: r.target for r in library.merge_names(names, ["u23"]).collect()}
    assert got == {"Le Pham Thanh Long": "Le Pham Thanh Long", "thanh long": "Le Pham Thanh Long", "Thành Long": "Le Pham Thanh Long", "a, b": "a, b"}


def test_canonical_names_go_on_after_the_alias(spark):
    alias = spark.createDataFrame([("Đình Bắc", "Bac")], "canonical string, variant string")
    living = spark.createDataFrame([("Van Hau", 2), ("Van Hau 2024", 9), ("a, Van Hau", 50)], "name string, n long")
    asks = ["Nguyen Dinh Bac", "Dinh Bac 2024", "bac", "Van Hau 2023", "Doan Van Hau", "Hau Van", "U23 Van Hau", "Hau, Bac", "Bac vs Hau", "x", None]
    names = spark.createDataFrame([(a,) for a in asks], "name string")
    got = {r.name: r.canonical for r in library.canonical_names_full(names, alias, living, ["u23"]).collect()}
    assert got == dict(zip(asks, ["Đình Bắc", "Đình Bắc", "Đình Bắc", "Van Hau", "Van Hau", "Hau Van", "U23 Van Hau", "Hau, Bac", "", "x", ""]))


def sequential(sets):
    founders, out = [], {}
    for k in sorted(sets):
        hit = next((f for f in founders if len(sets[k] & sets[f]) >= 3 and len(sets[k] & sets[f]) >= 0.5 * min(len(sets[k]), len(sets[f]))), None)
        if hit is None:
            founders.append(k)
        out[k] = k if hit is None else hit
    return out


@pytest.mark.parametrize("partitions", [1, 8])
def test_leader_clusters_equal_the_scan(spark, partitions):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(partitions)
    items = docs.select("doc_id", tx.keywords(F.array_join(F.slice(F.split("text", " "), 1, 24), " "), ["with"]).alias("s"))
    sets = {r.doc_id: set(r.s) for r in items.collect()}
    got = {r.doc_id: r.founder for r in board.clusters(items, "doc_id", "s").collect()}
    assert got == {k: f for k, f in sequential({k: s for k, s in sets.items() if len(s) >= 3}).items()} | {k: k for k, s in sets.items() if len(s) < 3}


def test_leader_clusters_of_a_long_drift(spark):
    # Each headline shares three of six words with its neighbours and with no other.
    sets = {i: {f"w{3 * i + j}" for j in range(6)} for i in range(500)}
    items = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "k long, s array<string>")
    assert {r.k: r.founder for r in board.clusters(items, "k", "s").collect()} == sequential(sets)


def test_leaders_in_rounds_equal_the_scan(spark):
    edges = spark.createDataFrame([(a, b) for b in range(1, 25) for a in range(b) if (a * 7 + b * 3) % 5 < 2], "a long, b long")
    rounds, scan = (Counter(tuple(r) for r in board.leaders(edges, few=n).collect()) for n in (0, 50_000))
    assert rounds == scan and rounds


def test_equal_titles_are_one_node(spark):
    items = spark.createDataFrame([(k, ["cup", "final", "tonight"]) for k in range(1000)] + [(2000, ["cup", "final"])], "k long, s array<string>")
    assert {r.k: r.founder for r in board.clusters(items, "k", "s").collect()} == {k: 0 for k in range(1000)} | {2000: 2000}
    assert sorted(tuple(r) for r in board.title_pairs(items, "k", "s").collect()) == [(0, k, 3) for k in range(1, 1000)]


def test_any_match_by_edges(spark):
    rows = [(1, 0, 0, 0), (2, -1, 0b11111, -1), (3, 0b1111111, -1, 0x0F0F0F0F), (4, 0b111111, -1 << 20, -1 << 30), (5, None, None, None), (6, -1, None, None)]
    got = library.any_match(spark.createDataFrame(rows, "k long, w long, t long, e long"), "k", {"w": 6, "t": 5, "e": 5}).collect()
    assert {r.k: r.match for r in got} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 2}


def test_search_survives_very_long_words(spark):
    base = "".join(chr(97 + i * i % 26) for i in range(20_000))
    assets = spark.createDataFrame([(1, "", "", f"{base} cup"), (2, "", "", base[:30] + "x" + base[30:60])], "asset long, subject string, labels string, description string")
    asks = spark.createDataFrame([(1, base[5_000:5_040]), (2, base[:60]), (3, "cop"), (4, base[:40] + "q" + base[40:])], "item long, q string")
    got = sorted(tuple(r) for r in search.strict(assets, asks, "asset", "item", "q").collect())
    assert got == [(1, 1, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1), (4, 1, 1)]


def test_search_takes_a_variant_for_the_name(spark):
    assets = spark.createDataFrame([(1, "Kim Sang-sik", "", "")], "asset long, subject string, labels string, description string")
    alias = spark.createDataFrame([("Kim Sang-sik", "HLV Kim")], "canonical string, variant string")
    asks = spark.createDataFrame([(1, "hlv kim"), (2, "hlv")], "item long, q string")
    assert [tuple(r) for r in search.strict(assets, asks, "asset", "item", "q", alias=alias).collect()] == [(1, 1, 27)]
    assert search.strict(assets, asks, "asset", "item", "q").count() == 0


def test_entities(spark):
    texts = ["a &eacute;&#8217;&#x1F600; &amp;lt;b&amp;gt;", "&unknown; & &amp", "fish &amp;amp;amp; chips", "&#0;x &#xD800;", "&copy;&nbsp;2024&frac12;", None, ""]
    want = [None if t is None else html.unescape(t) for t in texts]
    want[1] = "&unknown; & &amp"  # without a semicolon an entity stays
    want[3] = "\ufffdx \ufffd"
    assert value(spark, tx.unescape, *texts) == want
    assert value(spark, tx.clean_text, texts[0], texts[2], texts[4]) == ["a é’😀 <b>", "fish & chips", "© 2024½"]


def test_pacing(spark):
    rows = [(1, 0, 10.3, False, 2), (1, 1, 1.0, False, 0), (1, 2, 9.2, True, 2), (1, 3, 12.0, True, 0), (1, 4, 2.4, False, 0), (1, 5, 1.0, False, 0), (1, 6, 6.0, False, 0), (2, 0, 1.0, False, 0)]
    got = timeline.pace(spark.createDataFrame(rows, "v long, i long, length double, is_clip boolean, extra int"), "v", "i").collect()
    assert {(r.v, r.i): (r.parts, r.paced) for r in got} == {(1, 0): (3, 8.8), (1, 1): (1, 2.5), (1, 2): (3, 9.2), (1, 3): (1, 12.0), (1, 4): (1, 2.4), (1, 5): (1, 2.0), (1, 6): (2, 5.0), (2, 0): (1, 1.0)}


def test_club_gate(spark):
    assets = spark.createDataFrame([(1, "ha noi fc", ""), (2, "x", "plays for ha noi fc now"), (3, "viet nam", ""), (4, "thai lan", ""), (5, "hanoi fc", "fc thai")], "asset long, strong string, weak string")
    teams = spark.createDataFrame([("vn", "Việt Nam"), ("th", "Thái Lan"), ("hn", "Hà Nội FC")], "team string, alias string")
    gate = lambda **k: {r.asset: r.factor for r in library.team_gate(assets, "asset", "strong", "weak", teams, ["vn"], **k).collect()}
    assert gate() == {1: 0.0, 2: 0.4, 3: 1.0, 4: 0.0, 5: 1.0}
    assert gate(clubs=["hn"], national=True) == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 1.0}


def test_learned_labels(spark):
    q = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "q long, tokens array<string>")
    past = spark.createDataFrame([(7, "s", ["x", "y"], ["a", "b", "z"])], "past long, subject string, labels array<string>, tokens array<string>")
    assets = spark.createDataFrame([(1, "s", ["x"]), (2, "t", ["x", "y"]), (3, "t", ["w"])], "k long, subject string, labels array<string>")
    assert sorted(tuple(r) for r in search.learned_label_bonus(q, past, assets, "q", "k").collect()) == [(1, 1, 8), (1, 2, 4)]


def test_leaders_of_a_circle_raise(spark):
    with pytest.raises(ValueError):
        board.leaders(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"))


def test_hamming_banding_is_exact(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", tx.difference_bits(F.col("embedding")).alias("bits"))
    bits = {r.vec_id: r.bits for r in rows.collect()}
    want = {(a, b) for a in bits for b in bits if a < b and bits[a] != bits[b] and bin((bits[a] ^ bits[b]) & ((1 << 64) - 1)).count("1") <= 18}
    got = {(r.a, r.b) for r in library.hamming_matches(rows, "vec_id", "bits", 18).collect()}
    assert got == want


def test_image_classes_name_every_row(spark):
    rows = [(1, 0b111), (2, 0b111), (3, 0b110), (4, 0b110), (5, 0xFFFF << 40), (6, 0xFFFF << 40), (7, -1), (8, None), (9, 0xFF0)]
    got = {r.k: (r.match, r.links) for r in library.image_classes(spark.createDataFrame(rows, "k long, bits long"), "k", "bits", 6).collect()}
    far = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    hit = lambda x, y: x is not None and y is not None and far(x, y) <= 6
    want = {k: (min([k] + [j for j, y in rows if hit(x, y)]), sum(hit(x, y) for j, y in rows if j != k)) for k, x in rows}
    assert got == want and got[6] == (5, 1) and got[4] == (1, 3)


def test_image_classes_query_keeps_every_vector(spark):
    rows = catalog.QUERIES["j6_image_classes"](spark, SMALL)
    assert sorted(r.vec_id for r in rows.collect()) == sorted(r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())


def test_six_boards_stay_six(spark):
    rows = spark.createDataFrame([(i, 0x7F << (9 * i)) for i in range(6)], "k long, bits long")
    assert sorted(r.match for r in library.first_match(rows, "k", "bits", 6).collect()) == list(range(6))


def test_fold_tells_absent_from_later(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, None, "y"), (None, 3, "b", "z")], "k long, seq long, a string, b string")
    assert [tuple(r) for r in ledgers.fold(rows, "k", "seq", ["a", "b"]).collect()] == [(1, "a", "y")]


def test_pacing_keeps_the_sum(spark):
    rows = spark.createDataFrame([(1, 0, 10.3, False, 0), (1, 1, 1.0, False, 0), (1, 2, 4.0, True, 0)], "v long, i long, length double, is_clip boolean, extra int")
    got = sorted(tuple(r) for r in timeline.pace(rows, "v", "i").collect())
    assert [g[2] for g in got] == [3, 1, 1] and abs(sum(g[3] for g in got) - 15.3) < 1e-9 and got[1][3] == 2.5


def test_strict_search_needs_every_word(spark):
    assets = spark.createDataFrame([(1, "Đình Bắc", "goal, cup", "night"), (2, "Bac Ninh", "cup", "dinh")], "id long, subject string, labels string, description string")
    asks = spark.createDataFrame([(1, "dinh bac"), (2, "bac goall"), (3, "")], "q long, t string")
    got = sorted(tuple(r) for r in search.strict(assets, asks, "id", "q", "t").collect())
    assert got == [(1, 1, 18), (1, 2, 12), (2, 1, 11)]


@pytest.fixture()
def late(spark, tmp_path):
    """Two texts of 120 words with what is looked for near their ends, and no more."""
    fill = " ".join(f"w{i}x" for i in range(100))
    docs = [(1, f'{fill} zebra der, tag one / tag two "late goal"', "src"), (2, fill, "src")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w99x w3x zebra"), (2, "w1x w2x quagga")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_searches_read_whole_texts(spark, late):
    run = lambda name: catalog.QUERIES[name](spark, late).collect()
    assert [tuple(r) for r in run("q1_strict_search_whole")] == [(1, 1, 3 + 6 + 3)]
    assert {r.item_id: (r.hits, r.doc_id) for r in run("u4_rich_thin_whole")} == {1: (1, 1), 2: (0, None)}
    assert {r.token: r.c for r in run("a4_rarity")}["zebra"] == 1
    assert {(r.item_id, r.doc_id) for r in run("q2_soft_search_whole")} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_every_item_is_searched(spark, tmp_path):
    spark.createDataFrame([(i, "cup goal", "src") for i in range(40)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "cup"), (1, "goal"), (2, "quagga")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    best = sorted(range(40), key=lambda i: (-(6 + 5 * (i % 4 == 0) - 2 * (i == 0)), i))[:30]
    found = run("q3_search_library_all")
    for item in (0, 1):
        assert [r.doc_id for r in sorted((r for r in found if r.item_id == item), key=lambda r: r.place)] == best
    assert len(found) == 60
    assert sorted((r.item_id, r.turn) for r in run("w2_round_robin_all")) == [(q, n) for q in (0, 1) for n in range(1, 41)]


def test_all_events_are_read(spark):
    got = sorted(r.event_id for r in catalog.QUERIES["st4_read_all_since_cursor"](spark, SMALL).collect())
    assert got == sorted(r.event_id for r in spark.read.parquet(f"{SMALL}/events.parquet").collect())


def test_a_draft_has_eight_slots_a_video(spark, tmp_path):
    spark.createDataFrame([(1, "cup", "src")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "cup") for i in range(80)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.QUERIES["q7_draft_assignment"](spark, str(tmp_path)).collect()
    assert {(r.video, r.slot): r.asset for r in got} == {(i // 8, i % 8): 1 if i % 8 == 0 else None for i in range(80)}


def test_gate_and_tags_read_whole_texts(spark, late):
    run = lambda name: catalog.QUERIES[name](spark, late).collect()
    assert {r.doc_id: r.factor for r in run("j15_team_gate")} == {1: 0.4, 2: 1.0}
    assert {r.doc_id: r.n_tags for r in run("x6_tags")}[1] > 0
    assert any("late goal" in r.phrases for r in run("x18_highlight_phrases"))


def test_bonus_reads_whole_past_texts(spark, tmp_path):
    past = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(7, past)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "w38 w39")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in catalog.QUERIES["j21_learned_bonus"](spark, str(tmp_path)).collect()] == [(1, 0, 2, 8)]


def test_draft_uses_an_asset_once(spark):
    slots = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "video long, slot long")
    some = spark.createDataFrame([(1, 0, 1, 7), (1, 1, 1, 7), (1, 1, 2, 8), (1, 2, 1, 7)], "video long, slot long, rank int, asset long")
    assert sorted((r.slot, r.asset) for r in search.draft(slots, some, "video").collect()) == [(0, 7), (1, 8), (2, None)]


def test_ledger_skips_broken_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2, "new": 3}\n')
    assert sorted(r.a for r in readers.read_ledger(spark, str(tmp_path / "l.jsonl"), "a long").collect()) == [1, 2]


def test_feeds_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><pubDate>x</pubDate><link>u</link></item><item><title></title></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><updated>y</updated><link href="v"/></entry></feed>')
    (tmp_path / "c.xml").write_text("<rss><item><title>broken")
    got = sorted((r.title, r.stamp, r.link) for r in readers.read_feed(spark, str(tmp_path)).collect())
    assert got == [("A & B", "x", "u"), ("C", "y", "v")]


def test_documents_by_folder(spark, tmp_path):
    d = tmp_path / "2024-01-02" / "video-3-cup"
    d.mkdir(parents=True)
    (d / "doc.json").write_text('{\n "title": "t"\n}')
    assert [tuple(r) for r in readers.read_docs(spark, str(tmp_path), "title string").collect()] == [("t", "2024-01-02", "video-3-cup")]


def test_listing_of_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"123")
    (tmp_path / "._a.jpg").write_bytes(b"1")
    assert [r["size"] for r in readers.list_files(spark, str(tmp_path)).collect()] == [3]


def test_moods(spark):
    rows = spark.createDataFrame([(1, "Malaysia", "lầy"), (2, "tran lay", "vui va lay"), (3, "c++ wins", "sad"), (4, None, None), (5, "sad", "sad")], "k long, t string, b string")
    groups = {"fun": ["lầy", "vui"], "tech": ["c++"], "low": ["sad"]}
    got = {r.k: (r.mood, r.confidence) for r in library.emotion(rows, "k", F.col("t"), F.col("b"), groups, "none", folded=True).collect()}
    assert got == {1: ("fun", "fair"), 2: ("fun", "fair"), 3: ("tech", "high"), 4: ("none", "low"), 5: ("low", "high")}
    plain = {r.k: r.mood for r in library.emotion(rows, "k", F.col("t"), F.col("b"), groups, "none").collect()}
    assert plain[2] == "fun" and plain[1] == "fun"
    bare = spark.createDataFrame([(1, "lay", "lay")], "k long, t string, b string")
    assert [library.emotion(bare, "k", F.col("t"), F.col("b"), groups, "none", folded=f).first().mood for f in (False, True)] == ["none", "fun"]


def test_story_pictures(spark):
    articles = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, None), (1, 4, True), (2, 5, False)], "s long, a long, ok boolean")
    links = spark.createDataFrame([(2, "x", 0), (2, "y", 1), (4, "y", 0), (4, "z", 1), (1, "u", 0), (3, "v", 0), (1, "x", 1), (5, "x", 0)], "a long, url string, place int")

    def run(wanted, most):
        rows = library.story_pictures(articles, links, "s", "a", F.col("ok"), F.col("url") == "x", wanted, most)
        return sorted((r.s, r["rank"], r.a, r.url, r.flagged) for r in rows.collect())

    assert run(9, 9) == [(1, 1, 2, "y", False), (1, 2, 4, "z", False), (1, 3, 1, "u", False), (1, 4, 3, "v", False), (1, 5, 2, "x", True), (2, 1, 5, "x", True)]
    assert run(1, 9) == [(1, 1, 2, "y", False), (2, 1, 5, "x", True)]  # two URLs are gathered from the first article
    assert run(9, 1) == [(1, 1, 2, "y", False), (1, 2, 2, "x", True), (2, 1, 5, "x", True)]
    assert library.story_pictures(articles.limit(0), links, "s", "a", F.col("ok"), F.col("url") == "x", 1).count() == 0


def test_ranked_lists(spark):
    lists = [("v", 1, "3", ["0", "1", "9", "x", "2"], None, None), ("v", 2, " 3:0 ", ["1", "2"], "2", "3"), ("v", 3, "4", ["3", "2"], None, None), ("v", 4, "a", ["4"], None, None), ("v", 5, "5", ["4", "4"], "0", "0"), ("w", 1, "1", None, None, None)]
    pool = [(v, i, f"{v}{i}") for v in "vw" for i in range(5)]
    rows = search.ranked_lists(spark.createDataFrame(lists, "video string, at int, slot string, picks array<string>, a string, b string").withColumn("picks", F.transform("picks", lambda x: x.try_cast("int"))), spark.createDataFrame(pool, "video string, index int, asset string"), "video", "at", "slot", "picks", "a", "b")
    got = {(r.video, r.slot): (r.assets, r.paired) for r in rows.collect()}
    assert got == {("v", "3"): (["v0", "v1"], False), ("v", "3:0"): (["v2"], True), ("v", "4"): ([], False), ("v", "5"): (["v4"], False), ("w", "1"): ([], False)}
