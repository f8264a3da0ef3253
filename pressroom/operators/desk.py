"""Rules that put a script together: text routers, pairings, candidates and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_match, strip_marks


def highlight_phrases(c: Column, strong: list[str], before: list[str], units: list[str], share: float = 0.45) -> Column:
    """Up to two phrases of a title to highlight, the first found of: quoted ones of 3 to
    28 characters; scores (3-1) and numbers with one of ``units``; the first strong word
    (a word that has one of ``strong`` in it), with the word to its left if that is among
    ``before``, else with the one to its right. The shortest first they are kept while
    their words stay within a share of the title's, one word at least."""
    space = "[^ \\t\\n\\r\\f]+"
    quoted = F.transform(F.regexp_extract_all(c, F.lit("[\"“”']([^\"“”']{3,28})[\"“”']"), F.lit(1)), lambda p: F.trim(p))
    counted = F.regexp_extract_all(c, F.lit("(?iu)(\\b[0-9]+\\s*[-–]\\s*[0-9]+\\b|\\b[0-9]+\\s+(?:" + "|".join(f"\\Q{u}\\E" for u in units) + ")\\b)"), F.lit(1))
    words = F.regexp_extract_all(c, F.lit(f"({space})"), F.lit(1))
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "^[,.:;!?\"“”']+|[,.:;!?\"“”']+\\z", ""))
    single = [w for w in strong if len(w.split()) == 1]
    hits = F.transform(bare, lambda w: F.exists(F.array(*[F.lit(k) for k in single]), lambda k: F.contains(w, k)))
    i = F.array_position(hits, True).cast("int")
    left = (i > 1) & F.coalesce(F.get(bare, i - 2).isin(*before), F.lit(False))
    phrase = F.when(left, F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1))).otherwise(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    strongest = F.when(i > 0, F.array(F.regexp_replace(phrase, "^[,.:;!?]+|[,.:;!?]+\\z", ""))).otherwise(F.array().cast("array<string>"))
    found = F.slice(F.array_distinct(F.filter(F.concat(quoted, counted, strongest), lambda p: p != "")), 1, 2)
    room = F.greatest(F.lit(1), F.floor(F.size(words) * share).cast("int"))
    by_length = F.array_sort(F.transform(found, lambda p, n: F.struct(F.length(p).alias("l"), n.alias("n"), p.alias("p"))))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + F.size(F.regexp_extract_all(x["p"], F.lit(f"({space})"), F.lit(1)))
        return F.when(used <= room, F.struct(F.array_append(s["kept"], x["p"]).alias("kept"), used.alias("used"))).otherwise(s)

    return F.aggregate(by_length, start, step, lambda s: s["kept"])


def layout(title: Column, people: Column, teams: Column, pictures: Column) -> Column:
    """Cover layout by the first rule that holds."""
    return F.when((teams >= 2) & (pictures >= 2), "versus").when(title.rlike("[0-9]+ ?- ?[0-9]+"), "score").when((people >= 1) & (pictures >= 2), "duo").when(people >= 1, "portrait").when(title.rlike("[?]"), "question").otherwise("plain")


#: Marks that may stand around a line.
_MARKS = "`*_“”\"'"


def _label(labels: list[str]) -> str:
    return "[ \\t]*(?:#{1,4}[ \\t]*)?(?:\\*\\*)?[ \\t]*(?:" + "|".join(labels) + ")[ \\t]*\\d+"


def blocks(c: Column, labels: list[str]) -> Column:
    """Cut a free-form answer at its scene labels (a word of ``labels`` and a number at the
    start of a line), else at lines that begin with a quotation, else at blank lines; what
    gives fewer than two blocks is not taken. What stands before the first label or
    quotation is no block."""

    def cut(at: str) -> Column:
        return F.filter(F.split(c, f"(?imu)(?=^{at})"), lambda p: p.rlike(f"(?imu)\\A{at}"))

    named, quoted = cut(_label(labels)), cut("[ \\t]*[“\"'][^\"”\\n]{12,}")
    spaced = F.filter(F.split(c, "\\n\\s*\\n\\s*\\n?"), lambda p: F.trim(p) != "")
    return F.when(F.size(named) >= 2, named).when(F.size(quoted) >= 2, quoted).when(F.size(spaced) >= 2, spaced).otherwise(F.array(c))


def block_keywords(block: Column, labels: list[str], headings: list[str], lead_in: str = "(?!)", most_words: int = 9) -> Column:
    """The search keywords of a block, in order: listed lines (dash, dot, number), and bare
    lines of ``most_words`` words at most without the punctuation of a sentence; 3 to 90
    characters without the marks around them. ``headings`` alone on a line, labels,
    quotations and lines that begin with ``lead_in`` are none."""
    listed = "^\\s*(?:[-–—*•·]|\\d+[.)])\\s*(.+?)\\s*$"
    heading = "(?iu)^\\s*(?:" + "|".join(headings) + ")\\s*[:：]?\\s*$"

    def one(line: Column) -> Column:
        bare = F.trim(line)
        story = (bare == "") | bare.rlike("^(?:[“\"'#]|\\*\\*)") | (F.size(F.split(bare, "\\s+")) > most_words) | bare.rlike("[.,;:?!…]") | bare.rlike(f"(?iu)^{_label(labels)}")
        text = F.when(line.rlike(listed), F.regexp_extract(line, listed, 1)).when(~story, bare)
        return F.when(~line.rlike(heading) & ~line.rlike(f"(?iu)^{_label(labels)}"), F.regexp_replace(F.regexp_replace(text, f"^[{_MARKS}]+|[{_MARKS}]+$", ""), "\\s*[:：]\\s*$", ""))

    return F.filter(F.transform(F.split(block, "\\r?\\n"), one), lambda k: k.isNotNull() & F.length(k).between(3, 90) & ~k.rlike(f"(?iu)^(?:{lead_in})"))


def block_quote(block: Column) -> Column:
    """The first quotation of 12 to 400 characters, or bold line; null if there is none."""
    pattern = "(?m)[\"“”'’]([^\"“”]{12,400})[\"“”'’]|^\\*\\*(.{12,400})\\*\\*\\s*$"
    return F.coalesce(F.nullif(F.regexp_extract(block, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(block, pattern, 2), F.lit("")))


def marked_language(c: Column) -> Column:
    """Whether a keyword has a letter with a mark, or a barred d."""
    return (strip_marks(c) != F.lower(c)) | F.contains(F.lower(c), F.lit("đ"))


def parse_blocks(rows: DataFrame, key: str, text: str, labels: list[str], headings: list[str], lead_in: str = "(?!)") -> DataFrame:
    """(key, block, quote, plain, marked, keywords): the blocks of each text with their
    quotation, all keywords, and the longest without and with marked letters (the first of
    equals, null if there is none). Blocks without a keyword are kept."""
    each = rows.select(key, F.posexplode(blocks(F.col(text), labels)).alias("block", "_b"))
    each = each.withColumn("keywords", block_keywords(F.col("_b"), labels, headings, lead_in))

    def longest(of) -> Column:
        ranked = F.transform(F.filter("keywords", of), lambda k, i: F.struct(F.length(k).alias("l"), (-i).alias("i"), k.alias("k")))
        return F.array_max(ranked)["k"]

    return each.select(key, "block", block_quote(F.col("_b")).alias("quote"), longest(lambda k: ~marked_language(k)).alias("plain"), longest(marked_language).alias("marked"), "keywords")


def free_origins(regions: Column, margin: float = 0.22, crop: float = 0.5) -> Column:
    """[low, high] of the crop's left edge that keeps the marked spans (lo, hi) out of the
    picture: marks at the left push it right, marks at the right hold it back, a mark in
    the middle makes it impossible (null)."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0 - crop).alias("high"), F.lit(False).alias("never"))

    def step(s: Column, r: Column) -> Column:
        left, right = r["hi"] <= margin, r["lo"] >= 1 - margin
        low = F.when(left, F.greatest(s["low"], r["hi"])).otherwise(s["low"])
        high = F.when(right, F.least(s["high"], r["lo"] - crop)).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"), (s["never"] | ~(left | right)).alias("never"))

    return F.aggregate(regions, start, step, lambda s: F.when(~s["never"] & (s["low"] <= s["high"]), F.struct(s["low"].alias("low"), s["high"].alias("high"))))


def unknown_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names (video, name) whose folded form the dictionary lacks."""
    return names.withColumn("fold", fold_match(F.col("name"))).join(known.select(fold_match(F.col("name")).alias("fold")).distinct(), "fold", "left_anti").drop("fold")


def strip_name(query: Column, name: Column, team: Column) -> Column:
    """A query without the unknown name; the team in front if that is no longer there."""
    bare = F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), F.lower(query), F.lit(" ")), F.concat(F.lit(" "), F.lower(name), F.lit(" ")), F.lit(" ")), " +", " "))
    return F.when(F.contains(bare, F.lower(team)), bare).otherwise(F.concat_ws(" ", F.lower(team), bare))


def match_excerpts(excerpts: DataFrame, sentences: DataFrame, video: str) -> DataFrame:
    """One-to-one, in block order: equal text; containment over 20 letters; a common
    40-letter prefix; else the best word overlap of one half or more. Both sides of a
    video are short lists."""
    import pandas as pd

    both = excerpts.select(video, F.lit(0).alias("side"), "i", "text").unionByName(sentences.select(video, F.lit(1).alias("side"), "i", "text"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {k: pdf[pdf.side == k].sort_values("i")[["i", "text"]].values.tolist() for k in (0, 1)}
        free, out = dict(side[1]), []
        for i, text in side[0]:
            words, best = set(text.split()), (0, 0.0, None)
            for j, other in free.items():
                union = len(words | set(other.split()))
                jaccard = len(words & set(other.split())) / union if union else 0.0
                tier = 4 if text == other else 3 if min(len(text), len(other)) > 20 and (text in other or other in text) else 2 if min(len(text), len(other)) >= 20 and text[:40] == other[:40] else 1 if jaccard >= 0.5 else 0
                if tier and (tier, jaccard) > best[:2]:
                    best = (tier, jaccard, j)
            if best[2] is not None:
                free.pop(best[2])
                out.append((pdf[video].iloc[0], i, best[2], best[0]))
        return pd.DataFrame(out, columns=[video, "excerpt", "sentence", "tier"])

    return both.groupBy(video).applyInPandas(one, f"{video} long, excerpt long, sentence long, tier long")


def balance(rows: DataFrame, video: str, style: str, ratio: str, order: str, share: float = 0.65, least: int = 3) -> DataFrame:
    """If one style holds more than a share of a video's scenes, the least suited of its
    surplus (by shape) take the other style."""
    w = Window.partitionBy(video)
    counted = rows.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.count("*").over(Window.partitionBy(video, style)))
    rank = F.row_number().over(Window.partitionBy(video, style).orderBy(F.when(F.col(style) == "zoom", -F.col(ratio)).otherwise(F.col(ratio)), order))
    surplus = F.col("_k") - F.floor(share * F.col("_n"))
    flip = (F.col("_n") >= least) & (F.col("_k") > share * F.col("_n")) & (rank <= surplus)
    other = F.when(F.col(style) == "zoom", "pan").otherwise("zoom")
    return counted.withColumn("balanced", F.when(flip, other).otherwise(F.col(style))).drop("_n", "_k")


def vertical_pans(rows: DataFrame, video: str, style: str, ratio: str, order: str) -> DataFrame:
    """Of a video's zooms on upright pictures (ratio below 1) the more upright half become
    pans along their height (``tall``); one alone stays."""
    upright = (F.col(style) == "zoom") & (F.col(ratio) < 1)
    n = F.count(F.when(upright, 1)).over(Window.partitionBy(video))
    place = F.row_number().over(Window.partitionBy(video, upright).orderBy(ratio, order))
    return rows.withColumn("styled", F.when(upright & (place <= F.floor(n / 2)), "tall").otherwise(F.col(style)))


def capped_first_seen(rows: DataFrame, video: str, sentence: str, rank: str, url: str, cap: int) -> DataFrame:
    """URLs per sentence, each once per video in the order of sentences, at most ``cap``
    per sentence; one cut off by the cap is still free for later sentences. A video's list
    is folded in order; of an address that a sentence repeats its first rank counts."""
    one = rows.groupBy(video, sentence, url).agg(F.min(rank).alias("_r"))
    lists = one.groupBy(video, sentence).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", url))), lambda x: x[url]).alias("_u"))
    script = lists.groupBy(video).agg(F.sort_array(F.collect_list(F.struct(F.col(sentence).alias("s"), F.col("_u").alias("u")))).alias("_l"))
    text = f"array<{rows.schema[url].dataType.simpleString()}>"
    kind = f"array<struct<s:{rows.schema[sentence].dataType.simpleString()},u:{text}>>"
    start = F.struct(F.array().cast(text).alias("seen"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.slice(F.array_except(x["u"], s["seen"]), 1, cap)
        return F.struct(F.concat(s["seen"], new).alias("seen"), F.array_append(s["out"], F.struct(x["s"].alias("s"), new.alias("u"))).alias("out"))

    each = script.select(video, F.explode(F.aggregate("_l", start, step, lambda s: s["out"])).alias("o"))
    return each.select(video, F.col("o.s").alias(sentence), F.explode("o.u").alias(url))


def merged_candidates(sources: list[DataFrame], key: str, asset: str, order: str, used: DataFrame, most: int = 16) -> DataFrame:
    """Candidates of several sources in order of trust, each once, those in use left out."""
    ranked = [s.select(key, asset, F.struct(F.lit(i), F.col(order).cast("long")).alias("o")) for i, s in enumerate(sources)]
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    one = every.groupBy(key, asset).agg(F.min("o").alias("o")).join(used.select(key, asset), [key, asset], "left_anti")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("o", asset))).filter(F.col("place") <= most).select(key, asset, "place")


def scenes(rows: DataFrame, video: str, least: float = 1.0, most: float = 6.0) -> DataFrame:
    """Scenes of a video cut at 0 and at the starts of its sentences with a picture (start,
    picture, total): one shorter than ``least`` joins the scene before, and its picture
    counts as lost; ``long`` marks those over ``most`` seconds. Before the first picture
    there is a scene without one; of pictures that start together the least counts."""
    starts = rows.filter(F.col("start") < F.col("total")).groupBy(video, "start").agg(F.min("picture").alias("picture"), F.max("total").alias("total"))
    cuts = starts.groupBy(video).agg(F.max("total").alias("_total"), F.sort_array(F.collect_list(F.struct("start", "picture"))).alias("_c"))
    kind = rows.schema["picture"].dataType.simpleString()
    none = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(None).cast(kind).alias("picture")))
    cuts = cuts.withColumn("_c", F.when(F.col("_c")[0]["start"] > 0, F.concat(none, "_c")).otherwise(F.col("_c")))
    ends = F.transform("_c", lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(F.col("_c"), i + 1)["start"], F.col("_total")).alias("end"), x["picture"].alias("picture")))
    start = F.array().cast(f"array<struct<start:double,end:double,picture:{kind},lost:bigint>>")

    def step(out: Column, x: Column) -> Column:
        last, n = F.element_at(out, -1), F.size(out)
        joined = F.struct(last["start"].alias("start"), x["end"].alias("end"), last["picture"].alias("picture"), (last["lost"] + F.when(x["picture"].isNotNull(), 1).otherwise(0)).cast("long").alias("lost"))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["picture"].alias("picture"), F.lit(0).cast("long").alias("lost"))
        return F.when((n > 0) & (x["end"] - x["start"] < least), F.concat(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(joined))).otherwise(F.array_append(out, own))

    done = cuts.select(video, ends.alias("_e")).select(video, F.explode(F.aggregate("_e", start, step)).alias("s"))
    return done.select(video, "s.*", (F.col("s.end") - F.col("s.start") > most).alias("long"))


def chop(rows: DataFrame, video: str, low: float = 3.0, high: float = 4.0, snap: float = 0.9, least: float = 1.2) -> DataFrame:
    """Cut a video (ends of its sentences in ``end``) in scenes of ``low`` to ``high``
    seconds, drawn from a seed of the video, snapped to a sentence end nearby; a short
    rest joins the last scene, which reaches the end."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        ends = sorted(pdf.end)
        draw, total, cuts = random.Random(int(pdf[video].iloc[0])), ends[-1], [0.0]
        while total - cuts[-1] > high:
            t = cuts[-1] + draw.uniform(low, high)
            near = min(ends, key=lambda e: abs(e - t))
            t = near if abs(near - t) <= snap and near - cuts[-1] >= least else t
            if total - t < least:
                break
            cuts.append(t)
        return pd.DataFrame({video: pdf[video].iloc[0], "start": cuts, "end": [*cuts[1:], total]})

    return rows.select(video, "end").groupBy(video).applyInPandas(one, f"{video} long, start double, end double")


def colour_share(pixels: DataFrame, key: str, colour: str, top: int = 8) -> DataFrame:
    """Share of an image's pixels in its ``top`` commonest quantised colours."""
    bins = pixels.groupBy(key, colour).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), colour))
    return bins.withColumn("r", r).groupBy(key).agg(F.round(F.sum(F.when(F.col("r") <= top, F.col("n"))) / F.sum("n"), 6).alias("share"))
