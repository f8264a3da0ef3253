"""The desk's smaller rules, each with its lists and limits as arguments."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .board import stored


# ------------------------------------------------------------------ filters
def without_topics(rows: DataFrame, text: str, topics: list[str]) -> DataFrame:
    """Rows whose text, in lower case, has none of the topics in it; null texts go."""
    low = F.lower(text)
    return rows.filter(~reduce(or_, [F.contains(low, F.lit(x.lower())) for x in topics]))


def integer_entries(entries: Column, pattern: str = "^-?[0-9]+$") -> Column:
    """The entries of a map whose key is a whole number."""
    return F.map_filter(entries, lambda k, _: k.rlike(pattern))


def audit_status(seen: Column, awaiting: Column, unnamed: Column) -> Column:
    """unseen, awaiting, unnamed or done, by the first that holds."""
    return F.when(~F.coalesce(seen, F.lit(False)), "unseen").when(awaiting, "awaiting").when(unnamed, "unnamed").otherwise("done")


# ------------------------------------------------------------------ joins
def already_published(rows: DataFrame, key: str, title: Column) -> DataFrame:
    """Keys of rows with the title of a row before them, blanks around it and case apart."""
    named = rows.select(F.col(key), F.lower(F.trim(title)).alias("_t"))
    first = named.groupBy("_t").agg(F.min(key).alias("_first"))
    return named.join(first, "_t").filter(F.col(key) > F.col("_first")).select(key)


def rescuable(cuts: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """(key, origin): whether the original of a cut is still ``alive`` or ``lost``."""
    own = originals.select(key).distinct().withColumn("_o", F.lit(True))
    return cuts.select(key).join(own, key, "left").select(key, F.when(F.col("_o"), "alive").otherwise("lost").alias("origin"))


def national_team(text: Column, national: list[str], clubs: list[str], profile: Column | None = None) -> Column:
    """Whether an article is about a national team: it names at least one cue, and no fewer
    national ones than clubs. A ``profile`` that says so (true or false) has the last word."""
    low = F.lower(text)
    count = lambda cues: reduce(add, [F.contains(low, F.lit(c)).cast("int") for c in cues])
    found = (count(national) > 0) & (count(national) >= count(clubs))
    return found if profile is None else F.coalesce(profile, found)


def same_maps(mine: DataFrame, other: DataFrame, owner: str, slot: str, value: str) -> DataFrame:
    """(owner, current): whether an owner's two maps (slot to value) are the same; a slot
    that one of them lacks is a difference, unless the other has a null there."""
    a, b = mine.select(owner, slot, F.col(value).alias("_a")), other.select(owner, slot, F.col(value).alias("_b"))
    return a.join(b, [owner, slot], "full_outer").groupBy(owner).agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("current"))


def verdict_outcomes(rows: DataFrame, verdicts: DataFrame, key: str, subject: str) -> DataFrame:
    """(key, outcome) of pictures (key, subject, by_machine) that were looked at again
    (key, seen_as): ``match`` if the new eye sees the subject (or nothing is known),
    ``removed`` if it does not and a machine had named it, else ``kept``: what a human
    named is not taken away. Pictures that nobody looked at are ``unseen``."""
    eye = verdicts.groupBy(key).agg(F.max("seen_as").alias("_s"), F.lit(True).alias("_e"))
    outcome = F.when(F.col("_e").isNull(), "unseen").when(F.coalesce(F.col("_s") == F.col(subject), F.lit(True)), "match").when(F.col("by_machine"), "removed").otherwise("kept")
    return rows.join(eye, key, "left").select(key, outcome.alias("outcome"))


def link_lists(pages: DataFrame, group: str, url: str, order: str, size: int = 1000) -> DataFrame:
    """(group, part, links): each group's addresses, each once in order of first sight, in
    lists of ``size`` at most, so that no list grows with the pages."""
    one = pages.groupBy(group, url).agg(F.min(order).alias("_o"))
    placed = numbered(one, group, ["_o", url])
    lists = placed.groupBy(group, F.floor((F.col("n") - 1) / size).alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", url))).alias("_l"))
    return lists.select(group, "part", F.array_join(F.transform("_l", lambda s: s[url]), " ").alias("links"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``n``, their number from 1 in their group in the order of ``order``. A
    group may hold most of the rows: they are dealt to ranges of (group, order), counted for
    each range and group, and numbered inside."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, group, *order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "_p").agg(F.count("*").alias("_c"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy("_p", group).orderBy(*order))
    out = dealt.withColumn("_i", inside)
    met = out.join(base.withColumnsRenamed({group: "_g", "_p": "_q"}), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return met.withColumn("n", F.col("_i") + F.col("_base")).drop("_i", "_base", "_p", "_q", "_g")


def day_codes(rows: DataFrame, ts: str, tie: str) -> DataFrame:
    """Rows with ``code``: the day of ``ts`` and a number in order of time."""
    day = rows.withColumn("_day", F.date_format(ts, "yyyyMMdd"))
    return numbered(day, "_day", [ts, tie]).withColumn("code", F.concat("_day", F.lit("-"), F.col("n"))).drop("n", "_day")


# ------------------------------------------------------------------ summaries
def mark_verdicts(regions: DataFrame, asset: str, sure: Column, maybe: Column) -> DataFrame:
    """(asset, verdict): marked if a region is for sure, doubtful if one may be, else clean."""
    r = regions.groupBy(asset).agg(F.bool_or(sure).alias("_s"), F.bool_or(maybe).alias("_m"))
    return r.select(asset, F.when(F.col("_s"), "marked").when(F.col("_m"), "doubtful").otherwise("clean").alias("verdict"))


def job_list(slots: DataFrame, job: str, slot: Column, assigned: Column, flag: Column) -> DataFrame:
    """Per job how many sentences it has, how many of them have a picture, and whether any
    row is flagged. A slot is ``3`` or, a further picture of the sentence, ``3:0``."""
    sentence = F.split(slot, ":")[0]
    return slots.groupBy(job).agg(F.count_distinct(sentence).alias("sentences"), F.count_distinct(F.when(assigned, sentence)).alias("assigned"), F.bool_or(flag).alias("flagged"))


def keyword_edits(machine: DataFrame, human: DataFrame, job: str, slot: str, text: str) -> DataFrame:
    """(job, changes): the slots, in order, where a human has put another text than the
    machine's, with both."""
    m, h = machine.select(job, slot, F.col(text).alias("machine")), human.select(job, slot, F.col(text).alias("human"))
    diff = m.join(h, [job, slot]).filter("machine <> human")
    return diff.groupBy(job).agg(F.sort_array(F.collect_list(F.struct(slot, "machine", "human"))).alias("changes"))


def rotation_bonus(uses: Column, on_screen: Column, shown: int = 4, spare: int = 5, each: int = 2, most: int = 5) -> Column:
    """What a picture's past uses take off its score, and its tier adds."""
    return -each * F.least(uses, F.lit(most)) + F.when(on_screen, shown).otherwise(spare)


def cover_pictures(rows: DataFrame, video: str, w: Column, h: Column, people: Column, nobody: Column, assigned: str, order: str) -> DataFrame:
    """Rows with ``score`` and ``place`` in their video: pictures assigned to a sentence
    first, in its order (``assigned``, null for the others), then by score. 55 points for
    2.5 megapixels or their part, 30 to 0 for the shape, 45 with people, -40 without."""
    shape = F.when((w / h).between(1.3, 1.9), 30).when((w / h).between(1.0, 2.2), 20).when((w / h).between(0.6, 2.6), 8).otherwise(0)
    score = F.least(w * h / 2.5e6, F.lit(1.0)) * 55 + shape + F.when(people, 45).when(nobody, -40).otherwise(0)
    scored = rows.withColumn("score", F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy(video).orderBy(F.col(assigned).asc_nulls_last(), F.desc("score"), order))
    return scored.withColumn("place", rank)
