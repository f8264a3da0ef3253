"""The commands on a handful of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroom import api



def test_board(spark):
    rows = [
        (0, "Striker scores twice tonight again", "a", "vn", "2024-01-01 00:00:00", "http://a/1"),
        (1, "Tonight striker scores twice", "b", "eu", "2024-01-01 05:00:00", "http://news.google/2"),
        (2, "Chess masters gather quietly", "a", "eu", "2023-12-25 00:00:00", "http://a/3"),
        (3, "Tennis ball stuck somewhere", "a", "eu", "2024-01-01 05:00:00", "http://a/4"),
        (4, "", "a", "eu", None, None),
    ]
    items = spark.createDataFrame(rows, "seq long, title string, source string, region string, stamp string, link string")
    picks = spark.createDataFrame([("striker scores", True), ("chess masters", False)], "title string, picked boolean")
    board = api.build_board(items, picks, F.lit("2024-01-01 06:00:00").cast("timestamp"), ["with"], ["tennis"], ["striker"], ["twice"])
    got = [tuple(r) for r in board.select("founder", "heat", "n_sources", "links").collect()]
    assert got == [(0, 24 + 25 + 30 + 3 + 4, 2, "http://a/1"), (2, round((12 - 2.4) * 0.45), 1, "http://a/3")]
    first = board.first()["id"]
    assert [r.title for r in api.record_pick(board, [first], True, "2024-01-01").collect()] == [rows[0][1]]
    assert {(r.token, r.side) for r in api.learned_terms(picks, [], 1).collect()} == {("scores", "wanted"), ("chess", "unwanted")}


def test_ingest(spark):
    cand = spark.createDataFrame(
        [(10, 1, 0b1111, 900, 900, None, "dinh bac"), (11, 1, 0b1110, 900, 900, None, "x"), (12, 1, 1 << 40 | 0xFFFF0000, 400, 900, None, "x"), (13, 1, -1, 900, 900, "middle", "x"), (1, 1, 5, 900, 900, None, "x"), (14, 2, -(1 << 50), 900, 900, "top", "a vs b")],
        "asset long, job long, bits long, w int, h int, marked string, subject string",
    )
    ledger = spark.createDataFrame([(1, 0b0111_1111_1111_1111 << 30)], "asset long, bits long")
    shown = spark.createDataFrame([(10, 1)], "asset long, job long")
    alias = spark.createDataFrame([("Đình Bắc", "Bắc")], "canonical string, variant string")
    got = {r.asset: (r.decision, r.of, r.tier, r.subject) for r in api.ingest(cand, ledger, shown, alias).collect()}
    assert got == {10: ("new", None, "on_screen", "Đình Bắc"), 11: ("duplicate", 10, "spare", "x"), 12: ("small", None, "spare", "x"), 13: ("marked", None, "spare", "x"), 14: ("new", None, "spare", "")}


def test_article_and_reports(spark):
    assets = spark.createDataFrame([(1, "alpha", "cup", ""), (2, "beta", "alpha", "cup"), (3, "gamma", "", "alpha")], "asset long, subject string, labels string, description string")
    sentences = spark.createDataFrame([(1, 0, "alpha cup"), (1, 1, "gamma")], "article long, sentence long, query string")
    rarity = spark.createDataFrame([("alpha", 0.5)], "token string, weight double")
    gate = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.4)], "asset long, factor double")
    uses = spark.createDataFrame([(1, 1)], "asset long, uses long")
    got = [(r.asset, r.sentence, r.total) for r in api.library_for_article(assets, sentences, rarity, gate, uses).orderBy("place").collect()]
    assert got == [(1, 0, round((9 * 0.5 + 6) * 2 - 2, 6)), (3, 1, 7.2)]
    events = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:00:10"), (2, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:30")], "job long, stage string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [tuple(r) for r in api.stage_report(events, ["a", "b"], ["b"]).collect()] == [("a", 30.0, 2)]
    rows = spark.createDataFrame([("p", "high", "x", "y"), ("p", "low", "x", None)], "level string, confidence string, subject string, seen_as string")
    assert ("suspicion", "x -> y", 1) in {tuple(r) for r in api.audit_report(rows).collect()}
    names = spark.createDataFrame([("Le Long", 3), ("le long", 1)], "name string, n long")
    assert [tuple(r) for r in api.merge_report(names, []).collect()] == [("le long", "Le Long", 1)]
    shots = spark.createDataFrame([(1, "full", "Ad spot"), (2, None, "goal"), (3, "full", None)], "id long, k string, d string")
    assert sorted((r.id, r.kind) for r in api.video_list(shots, "k", "d", ["ad "]).collect()) == [(2, "cut"), (3, "full")]
    assert [r.id for r in api.review_list(shots, F.col("id") == 3, F.col("k").isNull(), "id", size=2).collect()] == [3, 2]
