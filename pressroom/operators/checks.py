"""Checks and choices of the desk: frames, clips, covers, music, flags, cues, halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_match
from .library import phrase_hits


def frame_violations(frames: DataFrame, video: str, t: str, region: str, channels: list[str], most: float = 46) -> DataFrame:
    """(video, region, violations, first): frames whose colour in a region is further than
    ``most`` from the video's first frame in any channel; how many of them, and the
    earliest. Regions that keep to the standard give no row."""
    own = frames.groupBy(video, region).agg(F.min_by(F.struct(*channels), t).alias("_s"))
    apart = F.greatest(*[F.abs(F.col(c) - F.col(f"_s.{c}")) for c in channels]) if len(channels) > 1 else F.abs(F.col(channels[0]) - F.col(f"_s.{channels[0]}"))
    off = frames.join(own, [video, region]).filter(apart > most)
    return off.groupBy(video, region).agg(F.count("*").alias("violations"), F.min(t).alias("first"))


def short_by_clips(rows: DataFrame, video: str, length: str, is_clip: str, least: float = 2.35) -> DataFrame:
    """Sentences without a clip that are shorter than ``least`` seconds, in videos that
    have a clip: they will be merged into a neighbour."""
    clips = rows.filter(is_clip).select(video).distinct()
    return rows.filter(~F.coalesce(F.col(is_clip), F.lit(False)) & (F.col(length) < least)).join(clips, video, "left_semi")


def least_repeated(jobs: DataFrame, items: DataFrame, history: DataFrame, job: str, group: str, item: str, order: str, draw: Column | None = None) -> DataFrame:
    """(job, item, why) for jobs (job, group): the item of the group that the job used last
    (``kept``); else one that nobody has used (``new``); else one of the half of the group
    that was used longest ago (``oldest``). ``history`` is (order, item, job); ``draw``, a
    number of the job, picks among equals. Groups without items leave a job without one."""
    last = history.groupBy(item).agg(F.max(order).alias("_last"))
    ranked = items.select(group, item).distinct().join(last, item, "left")
    every = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_last", F.lit(-1)).alias("l"), F.col(item).alias("i")))).alias("_l"))
    new = F.filter("_l", lambda x: x["l"] < 0)
    oldest = F.slice("_l", F.lit(1), F.greatest(F.lit(1), F.floor(F.size("_l") / 2).cast("int")))
    lists = every.select(group, F.when(F.size(new) > 0, new).otherwise(oldest)["i"].alias("_choice"), (F.size(new) > 0).alias("_new"))
    before = history.join(jobs.select(job, group), job).join(items.select(group, item).distinct(), [group, item], "left_semi").groupBy(job).agg(F.max_by(item, order).alias("_kept"))
    number = F.xxhash64(job) if draw is None else draw
    rows = jobs.join(before, job, "left").join(lists, group, "left")
    pick = F.get("_choice", F.pmod(number, F.size("_choice")).cast("int"))
    return rows.select(job, F.coalesce("_kept", pick).alias(item), F.when(F.col("_kept").isNotNull(), "kept").when(F.col("_new"), "new").when(F.col("_choice").isNotNull(), "oldest").alias("why"))


#: Points of the seven measures of a cover; they add up to 100.
COVER_WEIGHTS = {"clear_face": 22, "has_face": 16, "legible_small": 20, "text_stands_out": 14, "well_placed": 10, "balance": 8, "clean_overlay": 10}


def membership(x: Column, low: float, high: float) -> Column:
    """1 inside [low, high], falling to 0 over one width of the range beyond it."""
    outside = F.when(x < low, low - x).otherwise(x - high)
    return F.when(x.between(low, high), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - outside / max(1e-6, high - low)))


def cover_score(measures: dict[str, Column], weights: dict[str, int] = COVER_WEIGHTS, digits: int = 1) -> Column:
    """Points of a cover by its measures (0 to 1 each): the weighted sum, rounded. A measure that is null or not given counts nothing."""
    return F.round(sum((F.coalesce(measures[k].cast("double"), F.lit(0.0)) * w for k, w in weights.items() if k in measures), F.lit(0.0)), digits)


def clip_verdict(seconds: Column, deviation: Column, difference: Column, sharpness: Column, least: float = 4.5, flat: float = 8.0, frozen: float = 1.2, blurred: float = 60.0) -> Column:
    """The first that holds: broken (under 0.3 s or unknown), short, no frame (no
    deviation measured), flat, frozen (not if there was no second frame), blurred; else ok."""
    return (
        F.when(seconds.isNull() | (seconds < 0.3), "broken").when(seconds < least, "short").when(deviation.isNull(), "no frame")
        .when(deviation < flat, "flat").when(difference < frozen, "frozen").when(sharpness.isNull() | (sharpness < blurred), "blurred").otherwise("ok")
    )


def countries(text: Column, names: dict[str, str], ambiguous: list[str] | None = None, most: int = 2) -> Column:
    """Codes of the countries that a text names, at most ``most``: the longest names are
    looked for first and taken out of the text, so that a name inside another is not found
    again. Names of fewer than four letters, unless of two words, and ``ambiguous`` ones
    are not looked for. Names stand between characters that are no letters or digits."""
    usable = [(n, c) for n, c in sorted(names.items(), key=lambda x: -len(x[0])) if n not in (ambiguous or []) and (len(n) >= 4 or " " in n)]
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in usable])
    start = F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("t"), F.array().cast("array<string>").alias("codes"))

    def step(s: Column, x: Column) -> Column:
        pattern = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), x["n"], F.lit("\\E(?![\\p{L}\\p{N}_])"))
        found = F.when((F.size(s["codes"]) < most) & F.contains(s["t"], x["n"]), F.rlike(s["t"], pattern)).otherwise(False)
        codes = F.when(F.array_contains(s["codes"], x["c"]), s["codes"]).otherwise(F.array_append(s["codes"], x["c"]))
        return F.when(found, F.struct(F.replace(s["t"], x["n"], F.lit(" ")).alias("t"), codes.alias("codes"))).otherwise(s)

    return F.aggregate(table, start, step, lambda s: s["codes"])


def two_subject_cues(sentences: DataFrame, key: list[str], text: str, teams: DataFrame, people: DataFrame, article: str, contrast: list[str], statistics: list[str]) -> DataFrame:
    """(key, teams, people, contrast, statistics) of sentences with a sign of two subjects:
    two teams (``teams``: team, alias) or two people of the article (``people``: article,
    name), a phrase that contrasts, or one that introduces figures. Teams and people are
    looked up by equality on runs of words."""
    folded = F.concat(F.lit(" "), fold_match(F.col(text)), F.lit(" "))
    rows = sentences.select(*dict.fromkeys([*key, article]), F.struct(*key).alias("_k"), F.col(text).alias("_t"), folded.alias("_f"))
    called = teams.select("team", fold_match(F.col("alias")).alias("phrase")).distinct()
    named = phrase_hits(rows, "_k", "_t", called).join(called, "phrase").groupBy("_k").agg(F.count_distinct("team").alias("_teams"))
    folks = people.select(article, "name", fold_match(F.col("name")).alias("phrase")).distinct()
    own = phrase_hits(rows, "_k", "_t", folks).join(rows.select("_k", article), "_k").join(folks, [article, "phrase"]).groupBy("_k").agg(F.count_distinct("name").alias("_people"))
    has = lambda phrases, c: F.coalesce(F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col("_f"), F.concat(F.lit(c), p, F.lit(c)))), F.lit(False))
    out = rows.join(named, "_k", "left").join(own, "_k", "left")
    out = out.select(*key, (F.coalesce("_teams", F.lit(0)) >= 2).alias("teams"), (F.coalesce("_people", F.lit(0)) >= 2).alias("people"), has(contrast, " ").alias("contrast"), has(statistics, "").alias("statistics"))
    return out.filter(F.col("teams") | F.col("people") | F.col("contrast") | F.col("statistics"))


def split_frames(slots: DataFrame, sizes: DataFrame, video: str) -> DataFrame:
    """Each proposed split frame (video, slot, top, bottom, second, by_machine) with its
    decision: ``waiting`` without a first picture, ``human`` where someone has set the
    second one, ``tall top`` or ``tall bottom`` where a picture's known size is not
    landscape, ``same`` for one picture twice, else ``paired``. Sizes: (asset, w, h)."""
    own = sizes.select("asset", (F.col("w") >= F.col("h")).alias("wide"))
    rows = slots.join(own.withColumnRenamed("asset", "top").withColumnRenamed("wide", "_wt"), "top", "left").join(own.withColumnRenamed("asset", "bottom").withColumnRenamed("wide", "_wb"), "bottom", "left")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    decision = (
        F.when(empty("top"), "waiting").when(~empty("second") & ~F.coalesce("by_machine", F.lit(False)), "human").when(~F.coalesce("_wt", F.lit(True)), "tall top")
        .when(empty("bottom"), "missing").when(~F.coalesce("_wb", F.lit(True)), "tall bottom").when(F.col("top") == F.col("bottom"), "same").otherwise("paired")
    )
    return rows.select(video, "slot", decision.alias("decision"), F.when(decision == "paired", F.col("bottom")).otherwise(F.col("second")).alias("second"))


def harvest_pairs(approved: DataFrame, library: DataFrame, captions: DataFrame, asset: str, most: int = 6) -> DataFrame:
    """Approved rows (any columns, asset) with what their pictures show: subject and first
    ``most`` labels of the library's (asset, subject, labels), else the caption (asset,
    caption) as the only label. Rows of which nothing is known are left out."""
    lib = library.groupBy(asset).agg(F.max(F.struct("subject", "labels")).alias("_l"))
    cap = captions.groupBy(asset).agg(F.min("caption").alias("_c"))
    rows = approved.join(lib, asset, "left").join(cap, asset, "left")
    subject = F.coalesce("_l.subject", F.lit(""))
    own = F.slice(F.coalesce("_l.labels", F.array().cast("array<string>")), 1, most)
    caption = F.when(F.coalesce("_c", F.lit("")) != "", F.array("_c")).otherwise(F.array().cast("array<string>"))
    labels = F.when(F.size(own) > 0, own).otherwise(caption)
    return rows.select(*approved.columns, subject.alias("subject"), labels.alias("labels")).filter((F.col("subject") != "") | (F.size("labels") > 0))


def page(rows: DataFrame, order: list, number: int = 0, size: int = 60) -> DataFrame:
    """Page ``number`` (from 0) of the rows in an order without ties."""
    return rows.orderBy(*order).offset(number * size).limit(size)
