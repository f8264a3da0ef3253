"""Speech timing, carried pictures, pacing and warnings for scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count


def sentence_times(rows: DataFrame, video: str, index: str, text: str, seconds: Column) -> DataFrame:
    """End of each sentence: its share of the words so far of the video's seconds."""
    w = Window.partitionBy(video)
    counted = rows.withColumn("words", word_count(F.col(text)))
    so_far = F.sum("words").over(w.orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    ends = counted.withColumn("total", seconds).withColumn("end", F.round(so_far * F.col("total") / F.greatest(F.sum("words").over(w), F.lit(1)), 2))
    return ends.withColumn("start", F.coalesce(F.lag("end").over(w.orderBy(index)), F.lit(0.0))).withColumn("length", F.round(F.col("end") - F.col("start"), 2))


def carry_forward(rows: DataFrame, video: str, index: str, picture: str) -> DataFrame:
    """A sentence without a picture shows the latest earlier one."""
    w = Window.partitionBy(video).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("shown", F.last(picture, ignorenulls=True).over(w))


def long_stills(rows: DataFrame, video: str, index: str, picture: str, most: float = 6.0) -> DataFrame:
    """Runs of sentences under one picture for more than ``most`` seconds."""
    w = Window.partitionBy(video).orderBy(index)
    fresh = (~F.col(picture).eqNullSafe(F.lag(picture).over(w))).cast("int")
    runs = rows.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(video, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(picture).alias("picture"), F.count("*").alias("sentences"))
    return spans.filter(F.col("picture").isNotNull() & (F.col("end") - F.col("start") > most)).drop("_run")


def slot_ceiling(length: Column, each: float = 2.5) -> Column:
    """Pictures that fit a sentence: one per ``each`` seconds, at least one."""
    return F.greatest(F.lit(1), F.floor((length + 0.01) / each).cast("int"))


def round_robin(rows: DataFrame, group: str, order: list, first: Column) -> DataFrame:
    """One best row of each group per round; groups ranked by ``first``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).withColumn("place", first)


def active_at(times: DataFrame, spans: DataFrame, video: str, t: str) -> DataFrame:
    """The span [start, end) of the same video that is active at each time."""
    s = spans.select(F.col(video).alias("_v"), F.col("start").alias("_b"), F.col("end").alias("_e"), "scene")
    return times.join(s, (times[video] == F.col("_v")) & (F.col(t) >= F.col("_b")) & (F.col(t) < F.col("_e")), "left").drop("_v", "_b", "_e")


def even_marks(length: Column, low: int = 3, high: int = 14, least: int = 8, each: int = 6) -> Column:
    """Evenly spaced marks inside a clip; none if it is short."""
    n = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(length / each).cast("int")))
    return F.when(length < least, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.round(length * i / (n + 1), 6)))


def pace(rows: DataFrame, video: str, index: str, floor: float = 2.5, slack: float = 0.15, most: float = 5.0) -> DataFrame:
    """Parts and seconds of each sentence of a video (columns length, is_clip, extra).

    A sentence of d seconds has ceil(d / most) parts, a clip one; extra pictures open
    more, as many as have ``floor`` seconds each. Sentences that lack more than ``slack``
    of ``floor`` borrow up to it from the neighbours that are no clips, the longer first,
    as far as those keep ``floor`` a part. Last, parts that got too short are taken back,
    and sentences (no clips) with parts over ``most`` get more; a clip without extra
    pictures stays as it is. The sum stays. A video's sentences are few: they go to the
    rule as one row, many videos to a batch."""
    import math

    def one(length: list, is_clip: list, extras: list) -> list:
        given = [(float(x), bool(c), int(e)) for x, c, e in zip(length, is_clip, extras)]
        seconds = [x for x, _, _ in given]
        fits = [max(1, int((x + 0.01) // floor)) for x in seconds]
        parts = [max(1 if clip else max(1, math.ceil(x / most - 1e-9)), min(1 + extra, room) if extra else 1) for (x, clip, extra), room in zip(given, fits)]
        plain = [k for k, (_, clip, _) in enumerate(given) if not clip]
        for k in plain:
            need = floor - seconds[k]
            if need <= slack:
                continue
            sides = [j for j in (k - 1, k + 1) if j in range(len(given)) and not given[j][1]]
            for j in sorted(sides, key=lambda j: seconds[j], reverse=True):
                spare = min(need, seconds[j] - floor * parts[j])
                if spare > 0.01:
                    seconds[j], seconds[k], need = seconds[j] - spare, seconds[k] + spare, need - spare
                if need <= 0.01:
                    break
        for k, (_, clip, extra) in enumerate(given):
            if clip and not extra:
                continue
            while parts[k] > 1 and seconds[k] < (floor - 0.01) * parts[k]:
                parts[k] -= 1
            if not clip:
                parts[k] = max(parts[k], math.ceil(seconds[k] / (most + 0.01)))
        return [(n, round(x, 2)) for n, x in zip(parts, seconds)]

    rule = F.udf(one, "array<struct<parts:int,paced:double>>", useArrow=True)
    sentence = F.struct(F.col(index).isNull().alias("_last"), F.col(index).cast("long").alias("_i"), F.col("length").cast("double").alias("_x"), F.col("is_clip").alias("_c"), F.col("extra").cast("int").alias("_e"))
    script = rows.groupBy(video).agg(F.sort_array(F.collect_list(sentence)).alias("_s"))
    paced = script.select(F.col(video).cast("long").alias(video), F.col("_s._i").alias("_i"), rule("_s._x", "_s._c", "_s._e").alias("_p"))
    return paced.select(video, F.explode(F.arrays_zip("_i", "_p")).alias("_o")).select(video, F.col("_o._i").alias(index), "_o._p.parts", "_o._p.paced")


def merge_points(points: DataFrame, video: str, t: str, length: str, edge: float = 0.5, least: float = 1.5, most: int = 60) -> DataFrame:
    """Segments between change points; points at the ends, and segments that are too
    short, join what stands before."""
    known = points.groupBy(video).agg(F.max(F.col(length).cast("double")).alias("_n"), F.sort_array(F.collect_set(F.col(t).cast("double"))).alias("_t"))

    def step(cuts: Column, x: Column) -> Column:
        inside = (x > edge) & (x < F.col("_n") - edge) & (x - F.element_at(cuts, -1) >= least) & (F.size(cuts) < most)
        return F.when(inside, F.array_append(cuts, x)).otherwise(cuts)

    cuts = known.withColumn("_c", F.aggregate("_t", F.array(F.lit(0.0)), step))
    rest = (F.size("_c") > 1) & (F.col("_n") - F.element_at("_c", -1) < least)
    cuts = cuts.withColumn("_c", F.when(rest, F.slice("_c", F.lit(1), F.greatest(F.size("_c") - 1, F.lit(1)))).otherwise(F.col("_c")))
    each = F.transform("_c", lambda x, i: F.struct(x.alias("start"), F.coalesce(F.get(F.col("_c"), i + 1), F.col("_n")).alias("end")))
    return cuts.select(video, F.explode(each).alias("s")).select(video, "s.start", "s.end")


def spread(rows: DataFrame, video: str, index: str, share: float = 0.3, draw: Column | None = None) -> DataFrame:
    """Choose slots for clips (clip): never the first or last, never neighbours, a share of
    all at most (rounded, halves to even), in the order of ``draw``, a hash of video and slot
    unless given."""
    order = F.xxhash64(video, index) if draw is None else draw
    n = F.count("*").over(Window.partitionBy(video))
    place = F.row_number().over(Window.partitionBy(video).orderBy(index))
    slots = rows.select(video, index, order.alias("_d"), place.alias("_p"), n.alias("_n"))
    inner = slots.filter("_p > 1 AND _p < _n").groupBy(video, "_n").agg(F.sort_array(F.collect_list(F.struct("_d", "_p"))).alias("_l"))

    def step(chosen: Column, x: Column) -> Column:
        free = (F.size(chosen) < F.bround(F.col("_n") * share)) & ~F.exists(chosen, lambda c: F.abs(c - x["_p"]) <= 1)
        return F.when(free, F.array_append(chosen, x["_p"])).otherwise(chosen)

    picked = inner.select(video, F.aggregate("_l", F.array().cast("array<int>"), step).alias("_c"))
    return slots.join(picked, video, "left").select(video, index, F.coalesce(F.array_contains("_c", F.col("_p")), F.lit(False)).alias("clip"))
