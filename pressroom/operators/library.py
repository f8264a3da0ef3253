"""The picture and video library: gates, names, fingerprints, labels and counts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_keep, fold_match


def label_hygiene(rows: DataFrame, key: str, labels: str, most: int = 12) -> DataFrame:
    """Labels trimmed, one per folded spelling (the first), at most ``most``; rows without
    a label are left out. Each row is cleaned by itself: equal spellings are neighbours
    once its labels are sorted by them."""
    clean = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != "")
    spelt = F.sort_array(F.transform(clean, lambda x, i: F.struct(fold_match(x).alias("fold"), i.alias("pos"), x.alias("label"))))
    first = F.transform(F.array(spelt), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["fold"] != x["fold"])))[0]
    kept = F.slice(F.sort_array(F.transform(first, lambda x: F.struct(x["pos"], x["label"]))), 1, most)
    return rows.filter(F.size(clean) > 0).select(key, F.transform(kept, lambda x: x["label"]).alias("labels"))


def banded(rows: DataFrame, key: str, bits: str, bands: int) -> DataFrame:
    """(key, bits, band, value): 64 bits in ``bands`` runs. Hashes that differ in fewer
    bits than there are bands agree in at least one."""
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    parts = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft(F.col(bits), 64 - hi), 64 - (hi - lo)).alias("value")) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]
    return rows.select(key, bits, F.explode(F.array(*parts)).alias("p")).select(key, bits, "p.band", "p.value")


def agreeing(nodes: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """(key, bits, band, value): the bits that vary, cut in more runs than ``most``; of
    hashes that differ in at most ``most`` bits, as many runs agree as there are more, and
    every choice of so many is a row. With three runs at once a value is seldom met by
    chance; bits that are the same everywhere tell nothing apart and are left out."""
    ends = nodes.agg(F.bit_or(bits).alias("some"), F.bit_and(bits).alias("all")).first()
    vary = (ends["some"] or 0) & ~(ends["all"] or 0)
    places = [i for i in range(64) if vary >> i & 1]
    runs = max(1, min(len(places), most + (3 if most <= 8 else 2 if most <= 12 else 1)))
    edges = [round(len(places) * i / runs) for i in range(runs + 1)]
    masks = [sum(1 << i for i in places[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:])]
    chosen = [sum(c) for c in combinations(masks, max(0, runs - most))]
    parts = [F.struct(F.lit(i).alias("band"), F.col(bits).bitwiseAND(F.lit(m - (m >> 63 << 64)).cast("long")).alias("value")) for i, m in enumerate(chosen)]
    return nodes.select(key, bits, F.explode(F.array(*parts)).alias("p")).select(key, bits, "p.band", "p.value")


def hamming_matches(rows: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Pairs (a, b, distance) of different hashes with at most ``most`` differing bits,
    by runs of bits that agree exactly. Equal hashes are one node (their least key), so
    that a common image costs no pairs; a fold of ``first_match`` spreads the result."""
    from .board import stored

    nodes = stored(rows.filter(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(key).alias("k")))
    left = agreeing(nodes, "k", bits, most).select(F.col("k").alias("a"), F.col(bits).alias("x"), "band", "value")
    right = left.select(F.col("a").alias("b"), F.col("x").alias("y"), "band", "value")
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return left.join(right.hint("merge"), ["band", "value"]).filter((F.col("a") < F.col("b")) & (apart <= most)).select("a", "b", apart.alias("distance")).distinct()


def hamming_links(rows: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Pairs (a, b, distance) that hold every link: those of ``hamming_matches`` between
    the least keys of different hashes, and at distance 0 from the least key of a hash to
    every other row that has it."""
    known = rows.filter(F.col(bits).isNotNull()).select(F.col(key).alias("b"), bits)
    first = known.groupBy(bits).agg(F.min("b").alias("a"))
    copies = known.join(first, bits).filter(F.col("a") < F.col("b")).select("a", "b", F.lit(0).alias("distance"))
    return hamming_matches(rows, key, bits, most).unionByName(copies)


def first_match(rows: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Each row with the least key among rows of its hash or within ``most`` bits of it
    that come before it; itself if there is none."""
    pairs = hamming_matches(rows, key, bits, most)
    best = pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("a"))
    nodes = rows.filter(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(key).alias("node")).join(best, "node", "left")
    return rows.join(nodes.select(bits, F.least(F.coalesce("a", "node"), "node").alias("match")), bits, "left").select(key, F.coalesce("match", key).alias("match"))


def image_classes(rows: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """(key, match, links) for every row: its ``first_match``, and how many other rows have
    its hash or one within ``most`` bits of it."""
    nodes = rows.filter(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(key).alias("node"), F.count("*").alias("copies"))
    pairs = hamming_matches(rows, key, bits, most)
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.join(nodes.select(F.col("node").alias("other"), F.col("copies").alias("c")), "other").groupBy("node").agg(F.min("other").alias("first"), F.sum("c").alias("near"))
    per = nodes.join(near, "node", "left").select(bits, F.least(F.coalesce("first", "node"), "node").alias("match"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return rows.join(per, bits, "left").select(key, F.coalesce("match", key).alias("match"), F.coalesce("links", F.lit(0)).alias("links"))


def any_match(rows: DataFrame, key: str, hashes: dict[str, int]) -> DataFrame:
    """(key, match): the least key before it that is as near as the given number of bits
    by any of several hashes - of the whole picture, and of its top and bottom edge,
    which a cut at the other end leaves alone; itself if there is none. An unknown hash
    (null) matches nothing."""
    found = rows.select(key, F.col(key).alias("match"))
    for bits, most in hashes.items():
        nodes = rows.filter(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(key).alias("node"))
        pairs = hamming_matches(rows, key, bits, most)
        # Nodes are the least keys of their hashes: a row's candidates are those of its node, either way round.
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = nodes.join(both.groupBy("node").agg(F.min("other").alias("other")), "node", "left")
        found = found.unionByName(rows.join(best, bits).select(key, F.least("node", "other", key).alias("match")))
    return found.groupBy(key).agg(F.min("match").alias("match"))


def mergeable(a: Column, b: Column, blocking: list[str]) -> Column:
    """Whether two folded names are one subject: one's words are among the other's, in
    order, and no blocking word makes the difference."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    short, long = F.when(F.size(wa) <= F.size(wb), wa).otherwise(wb), F.when(F.size(wa) <= F.size(wb), wb).otherwise(wa)
    rest = F.array_except(long, short)
    ordered = F.aggregate(long, F.lit(1), lambda i, w: F.when(F.try_element_at(short, i).eqNullSafe(w), i + 1).otherwise(i)) == F.size(short) + 1
    return (F.size(F.array_except(short, long)) == 0) & ~F.arrays_overlap(rest, F.array(*[F.lit(w) for w in blocking])) & ordered


def canonical_names(names: DataFrame, alias: DataFrame, name: str = "name") -> DataFrame:
    """Name -> canonical: empty names and " vs " pairs become "", compounds stay, a known
    folded alias gives its canonical name, anything else stays. ``alias`` is (canonical,
    variant)."""
    table = alias.select(fold_match(F.col("variant")).alias("fold"), "canonical").unionByName(alias.select(fold_match(F.col("canonical")).alias("fold"), "canonical")).groupBy("fold").agg(F.min("canonical").alias("canonical"))
    n = F.trim(F.col(name))
    blank = n.isNull() | (n == "") | F.lower(n).contains(" vs ")
    kept = n.contains(",") | n.contains("&")
    joined = names.withColumn("fold", fold_match(n)).join(table, "fold", "left")
    return joined.select(name, F.when(blank, "").when(kept, n).otherwise(F.coalesce("canonical", n)).alias("canonical"))


def _choices(words: Column) -> Column:
    """Every choice of one, two or three of an array's words, in its order."""

    def behind(w: Column, i: Column) -> Column:
        return F.slice(w, i + 2, F.greatest(F.size(w) - i - 1, F.lit(0)))

    def with_one(w: Column, start: Column) -> Column:
        return F.transform(w, lambda z: F.concat_ws(" ", start, z))

    two = F.flatten(F.transform(words, lambda x, i: with_one(behind(words, i), x)))
    three = F.flatten(F.transform(words, lambda x, i: F.flatten(F.transform(behind(words, i), lambda y, j: with_one(behind(behind(words, i), j), F.concat_ws(" ", x, y))))))
    return F.concat(words, two, three)


def meeting(left: DataFrame, right: DataFrame, most: int = 12) -> DataFrame:
    """(fold, other): folded names of ``left`` (fold) and of ``right`` (other) such that all
    words of ``fold`` may be among those of ``other``. They meet on the three rarest words
    of ``fold``, or all of fewer, as one key: a word or two that many names have do not
    bring all those names together. Names of more than ``most`` words, of which every
    choice of three would be many, are met on the rarest word alone."""
    own = left.select("fold").distinct().withColumn("w", F.array_distinct(F.split("fold", " ")))
    wide = right.select("other").distinct().withColumn("w", F.array_sort(F.array_distinct(F.split("other", " "))))
    each = own.select("fold", F.explode("w").alias("word"))
    seldom = each.select("word").unionByName(wide.select(F.explode("w").alias("word"))).groupBy("word").agg(F.count("*").alias("c"))
    ranked = each.join(seldom, "word").groupBy("fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "word"))), lambda x: x["word"]).alias("r"))
    keys = F.array(F.array_join(F.array_sort(F.slice("r", 1, 3)), " "), F.concat(F.lit("="), F.col("r")[0]))
    offered = F.when(F.size("w") <= most, _choices(F.col("w"))).otherwise(F.transform("w", lambda x: F.concat(F.lit("="), x)))
    return ranked.select("fold", F.explode(keys).alias("key")).join(wide.select("other", F.explode(offered).alias("key")), "key").select("fold", "other")


def contained_pairs(left: DataFrame, right: DataFrame, blocking: list[str]) -> DataFrame:
    """(fold, other) of folded names of both sides (column fold) that are mergeable: they
    meet on the rarest words of the shorter, whichever side that is."""
    a, b = left.select("fold"), right.select(F.col("fold").alias("other"))
    back = meeting(b.select(F.col("other").alias("fold")), a.select(F.col("fold").alias("other"))).select(F.col("other").alias("fold"), F.col("fold").alias("other"))
    return meeting(a, b).unionByName(back).distinct().filter(mergeable(F.col("fold"), F.col("other"), blocking))


def canonical_names_full(names: DataFrame, alias: DataFrame, living: DataFrame, blocking: list[str], name: str = "name") -> DataFrame:
    """As ``canonical_names``, and names without an exact alias go on: the least canonical
    name of an alias that can be merged with them, else the best of the living names
    (name, n) that can, and of the name itself, by (no year, count, length, name)."""
    table = alias.select(fold_match(F.col("variant")).alias("fold"), "canonical").unionByName(alias.select(fold_match(F.col("canonical")).alias("fold"), "canonical")).filter("fold <> ''").groupBy("fold").agg(F.min("canonical").alias("canonical"))
    first = canonical_names(names.select(name).distinct(), alias, name)
    n = F.trim(F.col(name))
    simple = ~(n.contains(",") | n.contains("&") | F.lower(n).contains(" vs "))
    rest = first.filter(simple).select(name, n.alias("own"), fold_match(n).alias("fold")).filter("fold <> ''").join(table, "fold", "left_anti")
    known = contained_pairs(rest.select("fold").distinct(), table.select("fold"), blocking).join(table.withColumnRenamed("fold", "other"), "other").groupBy("fold").agg(F.min("canonical").alias("known"))
    live = living.select(F.trim("name").alias("l"), "n").groupBy("l").agg(F.sum("n").alias("n")).filter(~F.col("l").contains(",") & ~F.col("l").contains("&")).withColumn("other", fold_match(F.col("l"))).filter("other <> ''")
    year = lambda fold: ~F.col(fold).rlike(r"\b(19|20)[0-9]{2}\b")
    left = rest.join(known, "fold", "left_anti")
    pairs = contained_pairs(left.select("fold").distinct(), live.select(F.col("other").alias("fold")).distinct(), blocking)
    best = pairs.join(live, "other").groupBy("fold").agg(F.max(F.struct(year("other").alias("y"), F.col("n").cast("long").alias("n"), F.length("l").alias("length"), F.col("l").alias("name"))).alias("best"))
    counts = live.select(F.col("l").alias("own"), F.col("n").alias("of"))
    own = F.struct(year("fold").alias("y"), F.coalesce(F.col("of").cast("long"), F.lit(0)).alias("n"), F.length("own").alias("length"), F.col("own").alias("name"))
    by_name = left.join(best, "fold").join(counts, "own", "left").select(name, F.greatest("best", own)["name"].alias("found"))
    by_alias = rest.join(known, "fold").select(name, F.col("known").alias("found"))
    out = first.join(by_alias.unionByName(by_name), name, "left").select(F.col(name).alias("_n"), F.coalesce("found", "canonical").alias("canonical"))
    return names.select(name).join(out, F.col(name).eqNullSafe(F.col("_n")), "left").select(name, "canonical")


def merge_names(names: DataFrame, blocking: list[str]) -> DataFrame:
    """Distinct names with counts (name, n) -> (name, target). In order (no year first,
    count, length, name), a name attaches to the first kept name that it can be merged
    with, else it is kept. Candidate pairs share the rarest words of one (see ``meeting``), and
    whether a name is kept is settled in rounds (see ``board.leaders``)."""
    from .board import leaders, stored

    names = stored(names.select("name", "n"))  # read for keys, counts and targets
    simple = names.filter(~F.col("name").contains(",") & ~F.col("name").contains("&"))
    folded = simple.withColumn("fold", fold_match(F.col("name"))).filter("fold <> ''")
    order = F.struct(F.col("name").rlike("20[0-9][0-9]").alias("year"), (-F.col("n")).alias("n"), (-F.length("name")).alias("length"), "name")
    ranked = folded.withColumn("seq", order)
    folds = ranked.select("fold").distinct()
    near = meeting(folds, folds.select(F.col("fold").alias("other"))).filter((F.col("fold") == F.col("other")) | mergeable(F.col("fold"), F.col("other"), blocking)).distinct()
    other = ranked.select(F.col("name").alias("m"), F.col("fold").alias("other"), F.col("seq").alias("s"))
    pairs = near.join(ranked.select("name", "fold", "seq"), "fold").join(other, "other").filter(F.col("name") != F.col("m"))
    edges = pairs.select(F.when(F.col("seq") < F.col("s"), F.col("name")).otherwise(F.col("m")).alias("a"), F.when(F.col("seq") < F.col("s"), F.col("m")).otherwise(F.col("name")).alias("b")).distinct()
    seqs = ranked.select("name", "seq")
    found = leaders(edges)
    best = found.join(seqs.select(F.col("name").alias("a"), "seq"), "a").groupBy("b").agg(F.min_by("a", "seq").alias("target"))
    return names.join(best, names["name"] == best["b"], "left").select("name", F.coalesce("target", "name").alias("target"))


def usage(used: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Assets with their tier and the distinct jobs that show them, in order."""
    jobs = used.groupBy(key).agg(F.sort_array(F.collect_set("job")).alias("jobs"))
    joined = assets.join(jobs, key, "left")
    return joined.select(key, F.when(F.col("jobs").isNotNull(), "on_screen").otherwise("spare").alias("tier"), F.coalesce("jobs", F.array().cast("array<long>")).alias("jobs"))


def missing_both_ways(ledger: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Keys of the ledger without a file and of files without a row, each once; a null key
    has no counterpart. Both sides meet in one sum of flags: a task holds a key once and
    neither sorts nor joins."""
    sides = ledger.select(key, F.lit(1).alias("_s")).unionByName(files.select(key, F.lit(2).alias("_s")))
    met = sides.groupBy(key).agg(F.bit_or("_s").alias("_s")).filter((F.col("_s") < 3) | F.col(key).isNull())
    problems = F.array(F.when(F.col("_s").bitwiseAND(1) > 0, "no file"), F.when(F.col("_s").bitwiseAND(2) > 0, "no row"))
    return met.select(key, F.explode(F.array_compact(problems)).alias("problem"))


def subject_counts(rows: DataFrame, subject: str, seeds: DataFrame, query: str | None = None, most: int = 40) -> DataFrame:
    """Assets per subject; seed names appear with 0; a query keeps the names that hold
    all its folded words, whatever their rank."""
    counts = rows.groupBy(F.col(subject).alias("name")).agg(F.count("*").alias("n"))
    full = counts.join(seeds.select("name").distinct(), "name", "full_outer").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    for word in (query or "").lower().split():
        full = full.filter(fold_keep(F.col("name")).contains(word))
    return full.orderBy(F.desc("n"), "name").limit(60 if query else most)


def label_suggestions(rows: DataFrame, labels: str, order: str, most: int = 40) -> DataFrame:
    """Labels by how many assets carry them, whatever their case, in the first spelling."""
    each = rows.select(order, F.explode(F.array_distinct(labels)).alias("label")).filter((F.length("label") >= 3) & ~F.col("label").rlike("^[0-9]+$"))
    return each.groupBy(F.lower("label").alias("key")).agg(F.count("*").alias("n"), F.min_by("label", F.struct(order, "label")).alias("label")).orderBy(F.desc("n"), "key").limit(most)


def rarity(rows: DataFrame, key: str, tokens: str, low: float = 0.1) -> DataFrame:
    """Weight of each token by how few assets carry it, from ``low`` to 1."""
    each = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("c"))
    total = rows.agg(F.count("*").alias("total"))
    ratio = F.log(F.greatest(F.col("total") / F.col("c"), F.lit(1.01))) / F.log(F.greatest(F.col("total") / 5, F.lit(2.0)))
    return counts.crossJoin(F.broadcast(total)).select("token", "c", F.least(F.lit(1.0), F.greatest(F.lit(low), ratio)).alias("weight"))


def phrase_hits(rows: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, phrase) of the ``phrases`` (phrase, folded) whose words stand in a row in one
    run. Phrases of n words meet the rows' runs of n words by equality; the few lengths
    that phrases have are looked up first."""
    known = phrases.select("phrase").distinct().filter("phrase <> ''").withColumn("n", F.size(F.split("phrase", " ")))
    lengths = known.agg(F.sort_array(F.collect_set("n")).alias("lengths"))  # one row
    words = F.split(fold_match(F.col(text)), " ")
    each = rows.select(key, words.alias("_w")).crossJoin(F.broadcast(lengths)).select(key, "_w", F.explode("lengths").alias("n"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - F.col("n") + 1, F.lit(1)))
    runs = each.filter(F.size("_w") >= F.col("n")).select(key, "n", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("_w", i, F.col("n")), " ")))).alias("phrase"))
    return runs.join(known, ["n", "phrase"]).select(key, "phrase")


def team_gate(assets: DataFrame, key: str, strong: str, weak: str, teams: DataFrame, wanted: list[str], clubs: list[str] | None = None, national: bool = False) -> DataFrame:
    """Factor per asset: 0 if its subject or labels name a team that the article does
    not, 0.4 if only its description does, else 1. No gate without article teams. If the
    article is about a national team, a club (one of ``clubs``) that it does not name
    makes the factor 0 wherever it stands."""
    if not wanted:
        return assets.select(key, F.lit(1.0).alias("factor"))
    t = teams.select("team", fold_match(F.col("alias")).alias("phrase")).distinct().filter(~F.col("team").isin(*wanted))

    def named(text: str, out: str) -> DataFrame:
        hit = phrase_hits(assets, key, text, t).join(t, "phrase")
        club = F.col("team").isin(*clubs) if clubs else F.lit(False)
        return hit.groupBy(key).agg(F.lit(True).alias(out), F.bool_or(club).alias(f"{out}_club"))

    found = assets.select(key).join(named(strong, "s"), key, "left").join(named(weak, "w"), key, "left")
    club = F.lit(national) & (F.coalesce("s_club", F.lit(False)) | F.coalesce("w_club", F.lit(False)))
    return found.select(key, F.when(F.col("s") | club, 0.0).when(F.col("w"), 0.4).otherwise(1.0).alias("factor"))


def image_gate(w: Column, h: Column) -> Column:
    """Why a picture is too small or too narrow, or ok."""
    ratio = w / h
    return F.when(F.least(w, h) < 300, "tiny").when(~ratio.between(0.60, 2.20), "shape").when((F.greatest(w, h) >= 1920) & (F.least(w, h) >= 1080), "full").when(F.greatest(w, h) >= 1000, "preview").otherwise("small")


def health(w: Column, h: Column) -> Column:
    """Picture score: pixels up to 2 MP, shape, Full-HD; 0 for tiny ones."""
    ratio = w / h
    shape = F.when(ratio.between(1.3, 1.9), 25).when(ratio.between(1.0, 2.2), 16).when(ratio.between(0.6, 2.6), 6).otherwise(0)
    full = F.when((F.greatest(w, h) >= 1920) & (F.least(w, h) >= 1080), 20).otherwise(0)
    return F.when(F.least(w, h) < 300, 0.0).otherwise(F.least(w * h / 2e6, F.lit(1.0)) * 55 + shape + full)


def emotion(texts: DataFrame, key: str, title: Column, body: Column, groups: dict[str, list[str]], default: str, folded: bool = False) -> DataFrame:
    """Mood of a text by whole-word cues, 3 points in the title and 1 in the body; ties go
    to the earlier group; confidence by how far the winner is ahead. With ``folded``, texts
    without a hit are read again without marks, and so are the cues."""

    def ranked(title: Column, body: Column, turn) -> Column:
        scores = []
        for i, (name, cues) in enumerate(groups.items()):
            whole = [rf"(?<![\p{{L}}\p{{N}}]){re.escape(turn(c))}(?![\p{{L}}\p{{N}}])" for c in cues]
            # Most cues are not in a text at all, which a plain search says sooner.
            points = [F.when(title.contains(turn(c)) & title.rlike(w), 3).when(body.contains(turn(c)) & body.rlike(w), 1).otherwise(0) for c, w in zip(cues, whole)]
            scores.append(F.struct(reduce(add, points).alias("d"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
        return F.sort_array(F.array(*scores), asc=False)

    # The texts are turned once, as columns of their own, and not anew for each cue.
    read = texts.select(key, title.alias("_title"), body.alias("_body")).withColumns({"_t": F.lower("_title"), "_b": F.lower("_body")})
    found = read.withColumn("s", ranked(F.col("_t"), F.col("_b"), str))
    if folded:
        none = F.col("s")[0]["d"] <= 0
        found = found.withColumns({"_t": F.when(none, fold_keep(F.col("_title"))), "_b": F.when(none, fold_keep(F.col("_body")))})
        found = found.withColumn("s", F.when(none, ranked(F.col("_t"), F.col("_b"), unmarked)).otherwise(F.col("s")))
    one, two = F.col("s")[0], F.col("s")[1]
    sure = F.when((one["d"] >= 2 * two["d"]) & (one["d"] >= 3), "high").when(one["d"] > two["d"], "fair").otherwise("low")
    return found.select(key, F.when(one["d"] > 0, one["name"]).otherwise(default).alias("mood"), sure.alias("confidence"))


def unmarked(cue: str) -> str:
    """A cue as ``fold_keep`` would write it."""
    return "".join(c for c in unicodedata.normalize("NFD", cue.lower()) if unicodedata.category(c) != "Mn").replace("đ", "d")


def story_pictures(articles: DataFrame, links: DataFrame, story: str, article: str, serves: Column, flagged: Column, wanted: int, most: int = 5) -> DataFrame:
    """Pictures of a story from several of its articles: those of hosts that serve pictures
    first (null: not), then by key, at most ``most``, until twice the wanted number of
    distinct URLs is gathered. A URL stands where it is met first; of all, the ``wanted``
    first stay, flagged ones last. ``links`` has (article, url, place); a story's window
    never holds more than the links of ``most`` articles. Repeated rows of an article
    take turns of their own; articles without links give no row."""
    turn = F.row_number().over(Window.partitionBy(story).orderBy(F.when(serves, 0).otherwise(1), article))
    chosen = articles.select(story, article, turn.alias("turn")).filter(F.col("turn") <= most)
    met = chosen.join(links.select(article, "url", "place"), article)
    first = met.groupBy(story, "url").agg(F.min(F.struct("turn", "place", article)).alias("at"))
    before = F.count("*").over(Window.partitionBy(story).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    gathered = first.select(story, "url", "at.turn", "at.place", f"at.{article}").withColumn("before", before).filter(F.col("before") < 2 * wanted)
    rank = F.row_number().over(Window.partitionBy(story).orderBy("flagged", "turn", "place"))
    ordered = gathered.withColumn("flagged", F.coalesce(flagged, F.lit(False))).withColumn("rank", rank)
    return ordered.filter(F.col("rank") <= wanted).select(story, "rank", article, "url", "flagged")


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Content-hash gate: the first row of each key stays."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", r).filter("_r = 1").drop("_r")
