"""The desk's commands as compositions of the operators: board, library, search, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import board as bd
from .operators import desk, ledgers, library, search


# ------------------------------------------------------------------ board
def build_board(items: DataFrame, picks: DataFrame, now: Column, stop: list[str], off_topic: list[str], home: list[str], curious: list[str], aggregator: str = "news.google", top: int = 25) -> DataFrame:
    """Feed items (seq, title, source, region, stamp, link) to the ranked board: cleaned,
    off-topic titles dropped, near-equal titles clustered under the first, each cluster
    scored by sources, age, home interest, curiosity and what editors picked before.
    ``picks`` is (title, picked). Equal heat keeps the order of arrival."""
    title = tx.clean_text(F.col("title"))
    rows = items.withColumn("title", title).filter("title <> ''")
    if off_topic:
        low = F.lower("title")
        for term in off_topic:
            rows = rows.filter(~low.contains(term.lower()))
    rows = rows.withColumn("s", tx.keywords(F.col("title"), stop)).filter(F.size("s") >= 3)
    rows = bd.stored(rows.withColumn("age", tx.age_hours(tx.feed_time(F.col("stamp")), now)).join(bd.clusters(rows, "seq", "s"), "seq"))
    rolled = bd.roll_up(rows, "founder", "source", "link", "age", "seq", F.col("link").contains(aggregator))
    weights = bd.learned_words(picks.withColumn("s", tx.keywords(F.col("title"), stop)), "s", F.col("picked"))
    words = rows.select("founder", F.explode("s").alias("token")).distinct().join(weights, "token").groupBy("founder").agg(F.sum("weight").alias("learned"))
    low = F.lower("title")
    hit = lambda terms: sum((F.coalesce(F.contains(low, F.lit(w)), F.lit(False)).cast("int") for w in terms), F.lit(0))
    faces = rows.select(F.col("seq").alias("face"), "title", "region", (hit(home) > 0).alias("home"), hit(curious).alias("curious"))
    scored = rolled.join(faces, "face").join(words, "founder", "left")
    heat = bd.heat(F.col("n_sources"), F.col("age"), F.col("home"), F.col("curious"), F.coalesce("learned", F.lit(0.0)))
    return scored.select(tx.short_id(F.col("title")).alias("id"), heat.alias("heat"), "title", "n_sources", F.round("age", 1).alias("age"), "region", "sources", "links", "founder").orderBy(F.desc("heat"), "founder").limit(top)


def record_pick(board: DataFrame, ids: list[str], picked: bool, day: str) -> DataFrame:
    """Rows for the pick log."""
    return board.filter(F.col("id").isin(*ids)).select(F.lit(day).alias("day"), "id", F.lit(picked).alias("picked"), "title")


def learned_terms(picks: DataFrame, stop: list[str], n: int = 15) -> DataFrame:
    """The n most and n least wanted words."""
    w = bd.learned_words(picks.withColumn("s", tx.keywords(F.col("title"), stop)), "s", F.col("picked"))
    best = w.orderBy(F.desc("weight"), "token").limit(n).withColumn("side", F.lit("wanted"))
    return best.unionByName(w.orderBy("weight", "token").limit(n).withColumn("side", F.lit("unwanted")))


# ------------------------------------------------------------------ library
def ingest(candidates: DataFrame, ledger: DataFrame, shown: DataFrame, alias: DataFrame, most_bits: int = 6, least_side: int = 500, blocking: list[str] | None = None, edge_bits: int = 5) -> DataFrame:
    """Decide on candidate pictures (asset, job, bits, w, h, marked, subject) against the
    ledger (asset, bits): too small, marked in the middle, a duplicate (of the ledger or of
    an earlier candidate; the kept asset is named and credited) or new, with tier and
    canonical subject, also by the subjects of the ledger if it has them. Where both have
    the hashes of the edges (top, bottom), a picture that agrees in ``edge_bits`` of one is
    a duplicate too. ``shown`` is (asset, job)."""
    known = ledger.select("asset").distinct()
    fresh = candidates.join(known, "asset", "left_anti")
    reason = F.when(F.least("w", "h") < least_side, "small").when(F.col("marked") == "middle", "marked")
    gated = fresh.withColumn("reason", reason)
    edges = [c for c in ("top", "bottom") if c in candidates.columns and c in ledger.columns]
    pool = ledger.select(F.struct(F.lit(0).alias("o"), "asset").alias("k"), "bits", *edges).unionByName(gated.filter("reason IS NULL").select(F.struct(F.lit(1).alias("o"), "asset").alias("k"), "bits", *edges))
    same = library.any_match(pool, "k", {"bits": most_bits} | dict.fromkeys(edges, edge_bits)).select(F.col("k.asset").alias("asset"), F.col("match.asset").alias("match"))
    subjects = candidates.select(F.col("subject").alias("name")).distinct()
    living = ledger.filter("subject IS NOT NULL").groupBy(F.col("subject").alias("name")).agg(F.count("*").alias("n")) if "subject" in ledger.columns else subjects.limit(0).withColumn("n", F.lit(0).cast("long"))
    names = library.canonical_names_full(subjects, alias, living, blocking or []).withColumnRenamed("name", "subject")
    on_screen = shown.select("asset", F.lit(True).alias("shown")).distinct()
    rows = gated.join(same, "asset", "left").join(on_screen, "asset", "left").join(names, "subject", "left")
    decision = F.coalesce("reason", F.when(F.col("match") != F.col("asset"), "duplicate").otherwise("new"))
    return rows.select("asset", "job", decision.alias("decision"), F.when(decision == "duplicate", F.col("match")).alias("of"), F.when(F.coalesce("shown", F.lit(False)), "on_screen").otherwise("spare").alias("tier"), F.coalesce("canonical", F.lit("")).alias("subject"))


def review_list(rows: DataFrame, rough: Column, unnamed: Column, stored: str, query: str = "", text: str = "text", page: int = 0, size: int = 60) -> DataFrame:
    """A page of the review list: with a query its matches, else rough rows first, then
    unnamed ones, the oldest first."""
    for word in query.lower().split():
        rows = rows.filter(tx.fold_keep(F.col(text)).contains(word))
    return rows.withColumn("_r", ~rough).withColumn("_u", ~unnamed).orderBy("_r", "_u", stored).drop("_r", "_u").offset(page * size).limit(size)


def merge_report(names: DataFrame, blocking: list[str]) -> DataFrame:
    """What a name merge would change (a dry run): name, target, rows."""
    return library.merge_names(names, blocking).join(names, "name").filter("name <> target").select("name", "target", "n")


def video_list(rows: DataFrame, kind: str, description: str, adverts: list[str]) -> DataFrame:
    """Videos with their kind (cut where none is named), adverts left out."""
    low = F.lower(F.coalesce(description, F.lit("")))
    for a in adverts:
        rows = rows.filter(~low.startswith(a))
    return rows.withColumn("kind", F.coalesce(kind, F.lit("cut")))


# ------------------------------------------------------------------ search
def library_for_article(assets: DataFrame, sentences: DataFrame, rarity: DataFrame, gate: DataFrame, uses: DataFrame, key: str = "asset", page: int = 150, bonus: DataFrame | None = None, alias: DataFrame | None = None) -> DataFrame:
    """Assets for the sentences (article, sentence, query) of many articles at once: each
    asset under its best sentence. Its score is the soft one, 4 more on screen (a column
    of ``uses`` next to key and uses), 2 less for each use up to five, plus the learned
    ``bonus`` (article, sentence, key, bonus) of that sentence; gated (key, factor) at
    last. One asset per sentence in turn, the sentences in order, ``page`` in all."""
    asked = sentences.withColumn("q", F.struct("article", "sentence"))
    best = search.soft(assets, asked, rarity, key, "q", "query", alias=alias).filter("score > 0").select("q.article", "q.sentence", key, "score")
    best = best.groupBy("article", key).agg(F.max_by("sentence", F.struct("score", -F.col("sentence"))).alias("sentence"), F.max("score").alias("score"))
    scored = best.join(gate, key).filter("factor > 0").join(uses, key, "left")
    scored = scored.join(bonus, ["article", "sentence", key], "left") if bonus is not None else scored.withColumn("bonus", F.lit(0))
    shown = F.when(F.col("on_screen"), 4).otherwise(0) if "on_screen" in uses.columns else F.lit(0)
    points = F.col("score") + shown - 2 * F.least(F.coalesce("uses", F.lit(0)), F.lit(5)) + F.coalesce("bonus", F.lit(0))
    total = scored.withColumn("total", F.round(points * F.col("factor"), 6))
    turn = F.row_number().over(Window.partitionBy("article", "sentence").orderBy(F.desc("total"), key))
    place = F.row_number().over(Window.partitionBy("article").orderBy("turn", "sentence"))
    return total.withColumn("turn", turn).withColumn("place", place).filter(F.col("place") <= page).select("article", "sentence", key, "total", "place")


def slot_candidates(ranked: DataFrame, found: DataFrame, web: DataFrame, used: DataFrame, n: int = 16) -> DataFrame:
    """Candidates of a slot: model list, library, web, in that order of trust."""
    return desk.merged_candidates([ranked, found, web], "slot", "asset", "rank", used, n)


# ------------------------------------------------------------------ ledgers
def stage_report(rows: DataFrame, stages: list[str], done: list[str]) -> DataFrame:
    """Upper median of the seconds of each step over all jobs, and how many jobs."""
    spans = ledgers.stage_durations(rows, "job", "stage", "ts", stages, done)
    return ledgers.upper_median(spans, "stage", "seconds")


def audit_report(rows: DataFrame, n: int = 10) -> DataFrame:
    """One table of (part, name, n): progress by level and confidence, subjects and
    suspicions (recorded -> read), each list with its most frequent n."""
    count = F.count("*").alias("n")

    def part(name: str, column: Column, of: DataFrame = rows) -> DataFrame:
        return of.groupBy(column.cast("string").alias("name")).agg(count).orderBy(F.desc("n"), "name").limit(n).select(F.lit(name).alias("part"), "name", "n")

    doubts = rows.filter(F.col("seen_as").isNotNull() & (F.col("seen_as") != F.col("subject")))
    return part("level", F.col("level")).unionByName(part("confidence", F.col("confidence"))).unionByName(part("subject", F.col("subject"))).unionByName(part("suspicion", F.concat_ws(" -> ", "subject", "seen_as"), doubts))
