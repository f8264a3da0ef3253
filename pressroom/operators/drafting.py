"""Drafts of a video: pictures for its slots from four sources, pictures dealt in passes,
and directions of movement. What must be decided in order is folded over one video's
script (a few dozen rows) inside the JVM; everything around it is joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .library import banded


def in_library(candidates: DataFrame, library: DataFrame, key: str, hashes: dict[str, int]) -> DataFrame:
    """(key, known) of candidate pictures: whether one of the library's is as near as the
    given number of bits by any of several hashes (columns of both sides). Null hashes
    match nothing; candidates and the library meet on exact bands of the hash."""
    near = None
    for bits, most in hashes.items():
        mine = candidates.filter(F.col(bits).isNotNull()).select(F.col(bits).alias("x")).distinct()
        own = library.filter(F.col(bits).isNotNull()).select(F.col(bits).alias("y")).distinct()
        left = banded(mine, "x", "x", most + 1).select("x", "band", "value")
        right = banded(own, "y", "y", most + 1).select("y", "band", "value")
        met = left.join(right, ["band", "value"]).filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most).select(F.col("x").alias(bits)).distinct()
        hit = candidates.join(met, bits).select(key)
        near = hit if near is None else near.unionByName(hit)
    return candidates.select(key).distinct().join(near.distinct().withColumn("_k", F.lit(True)), key, "left").select(key, F.coalesce("_k", F.lit(False)).alias("known"))


def _gathered(rows: DataFrame, video: str, name: str, order: list, fields: list[str]) -> DataFrame:
    """One list a slot of ``fields``, in order."""
    keys = [c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    return rows.groupBy(video, "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct(*keys, *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def tiered_draft(slots: DataFrame, semantic: DataFrame, hits: DataFrame, web: DataFrame, video: str, least: float = 4.0, most: int = 6) -> DataFrame:
    """(video, slot, tier, asset, thrown) for every open slot (video, place, slot).

    In the order of ``place`` a slot takes the first that is still free of: its semantic
    list (``semantic``: video, slot, assets); of the library's ``most`` best hits
    (``hits``: video, slot, asset, score) those that score ``least`` or more; of the
    ``most`` healthiest web candidates (``web``: video, slot, url, health, seq, known)
    those that the library does not know. An empty semantic list says that the library
    has nothing: such a slot goes straight to the web. A library asset or an address
    serves one slot of a video. ``thrown`` counts the web candidates passed over because
    the library knows them. Tiers: semantic, library, web, missing."""
    known = semantic.select(video, "slot", F.transform("assets", lambda a: a.cast("string")).alias("_sem"))
    score = F.col("score").cast("double")
    best = Window.partitionBy(video, "slot").orderBy(F.desc("score"), "asset")
    top = hits.withColumn("_r", F.row_number().over(best)).filter((F.col("_r") <= most) & (score >= least)).select(video, "slot", "_r", F.col("asset").cast("string").alias("asset"))
    lib = _gathered(top, video, "_hits", ["_r"], ["asset"])
    healthy = Window.partitionBy(video, "slot").orderBy(F.desc("health"), "seq")
    tried = web.withColumn("_r", F.row_number().over(healthy)).filter(F.col("_r") <= most).select(video, "slot", "_r", F.col("url").cast("string").alias("url"), F.coalesce("known", F.lit(False)).alias("known"))
    net = _gathered(tried, video, "_web", ["_r"], ["url", "known"])
    rows = slots.select(video, "place", "slot").join(known, [video, "slot"], "left").join(lib, [video, "slot"], "left").join(net, [video, "slot"], "left")
    script = rows.groupBy(video).agg(F.sort_array(F.collect_list(F.struct("place", "slot", "_sem", F.col("_hits.asset").alias("_hits"), "_web"))).alias("_script"))
    text = "array<string>"
    kind = rows.schema["slot"].dataType.simpleString()
    start = F.struct(F.array().cast(text).alias("taken"), F.array().cast(text).alias("used"), F.array().cast(f"array<struct<slot:{kind},tier:string,asset:string,thrown:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        free = lambda a: F.coalesce(F.array_except(F.coalesce(a, F.array().cast(text)), s["taken"]), F.array().cast(text))
        sem = F.get(free(x["_sem"]), F.lit(0))
        none = x["_sem"].isNotNull() & (F.size(x["_sem"]) == 0)
        hit = F.when(~none, F.get(free(x["_hits"]), F.lit(0)))
        open_web = F.filter(F.coalesce(x["_web"], F.array().cast("array<struct<url:string,known:boolean>>")), lambda w: ~F.array_contains(s["used"], w["url"]))
        first = F.get(F.filter(open_web, lambda w: ~w["known"]), F.lit(0))["url"]
        before = F.when(first.isNull(), F.size(F.filter(open_web, lambda w: w["known"]))).otherwise(F.array_position(F.transform(F.transform(open_web, lambda w: F.when(~w["known"], w["url"])), lambda u: F.coalesce(u, F.lit(""))), first).cast("int") - 1)
        library = F.coalesce(sem, hit)
        tier = F.when(sem.isNotNull(), "semantic").when(hit.isNotNull(), "library").when(first.isNotNull(), "web").otherwise("missing")
        asset = F.coalesce(library, first)
        grown = F.struct(x["slot"].alias("slot"), tier.alias("tier"), asset.alias("asset"), F.when(library.isNull(), before).otherwise(0).cast("int").alias("thrown"))
        return F.struct(
            F.when(library.isNotNull(), F.array_append(s["taken"], library)).otherwise(s["taken"]).alias("taken"),
            F.when(library.isNull() & first.isNotNull(), F.array_append(s["used"], first)).otherwise(s["used"]).alias("used"),
            F.array_append(s["out"], grown).alias("out"),
        )

    return script.select(video, F.explode(F.aggregate("_script", start, step, lambda s: s["out"])).alias("o")).select(video, "o.*")


def draft_counters(draft: DataFrame, video: str) -> DataFrame:
    """How many slots of a video each tier filled (``library`` includes the semantic
    ones), how many are missing and how many web candidates were thrown away."""
    n = lambda *tiers: F.count_if(F.col("tier").isin(*tiers))
    return draft.groupBy(video).agg(n("semantic", "library").alias("library"), n("semantic").alias("semantic"), n("web").alias("web"), n("missing").alias("missing"), F.sum("thrown").alias("thrown"))


def shuffled_allotment(scenes: DataFrame, pictures: DataFrame, video: str, seed: int = 7) -> DataFrame:
    """(video, place, picture) for scenes (video, n) from pictures (video, picture): whole
    passes over all pictures, each in an order of its own drawn from video, pass and
    ``seed``; where a pass would begin with the picture that the one before ended with,
    its first two change places. So uses differ by one at most, and with two pictures or
    more no neighbours are equal. Videos without pictures give no rows."""
    size = pictures.select(video, "picture").distinct().groupBy(video).agg(F.count("*").alias("_m"))
    passes = scenes.join(size, video).select(video, "n", "_m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("_m")).cast("int") - 1)).alias("_p")).filter("n > 0")
    key = F.struct(F.xxhash64(F.lit(seed), video, "_p", "picture"), "picture")
    every = passes.join(pictures.select(video, "picture").distinct(), video)
    own = every.withColumn("_i", F.row_number().over(Window.partitionBy(video, "_p").orderBy(key)) - 1)
    ends = every.groupBy(video, "_p", "_m").agg(F.min_by("picture", key).alias("_first"), F.max_by("picture", key).alias("_last"))
    # With two pictures every pass repeats the first one's order; with more a swap leaves the end alone.
    pair = Window.partitionBy(video)
    zero = F.max(F.when(F.col("_p") == 0, F.col("_first"))).over(pair)
    clash = F.when(F.col("_m") == 2, F.col("_first") != zero).otherwise((F.col("_m") > 2) & F.coalesce(F.lag("_last").over(pair.orderBy("_p")) == F.col("_first"), F.lit(False)))
    swap = ends.select(video, "_p", clash.alias("_s"))
    place = F.when(F.col("_s") & (F.col("_i") < 2), 1 - F.col("_i")).otherwise(F.col("_i"))
    return own.join(swap, [video, "_p"]).select(video, (F.col("_p") * F.col("_m") + place).cast("long").alias("place"), "picture", "n").filter("place < n").drop("n")


def directions(scenes: DataFrame, video: str, place: str, style: str, choices: dict[str, list[str]], start: Column | None = None) -> DataFrame:
    """Every scene with its ``direction``: of those its style can take, without the one of
    the scene before (unless it is the only one), one that the video has used least; ties
    go round from ``start``, drawn from video and place if not given. A style with one
    choice takes it and is not counted; a style without choices has no direction."""
    turn = F.pmod(F.xxhash64(video, place), F.lit(1 << 20)) if start is None else start
    rows = scenes.withColumn("_t", turn.cast("int"))
    script = rows.groupBy(video).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("_place"), F.col(style).alias("_style"), "_t"))).alias("_s"))
    text = "array<string>"
    table = F.create_map(*[x for k, v in sorted(choices.items()) for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    begin = F.struct(F.array().cast(text).alias("used"), F.lit(None).cast("string").alias("before"), F.array().cast("array<struct<_place:%s,direction:string>>" % rows.schema[place].dataType.simpleString()).alias("out"))

    def step(s: Column, x: Column) -> Column:
        every = F.coalesce(F.try_element_at(table, x["_style"]), F.array().cast(text))
        n = F.size(every)
        other = F.filter(every, lambda d: ~d.eqNullSafe(s["before"]))
        can = F.when(F.size(other) > 0, other).otherwise(every)
        ranked = F.transform(can, lambda d: F.struct(F.size(F.filter(s["used"], lambda u: u == d)).alias("n"), F.pmod(F.array_position(every, d).cast("int") - 1 - x["_t"], F.greatest(n, F.lit(1))).alias("o"), d.alias("d")))
        pick = F.array_min(ranked)["d"]
        out = F.struct(x["_place"].alias("_place"), pick.alias("direction"))
        return F.struct(F.when(n > 1, F.array_append(s["used"], pick)).otherwise(s["used"]).alias("used"), pick.alias("before"), F.array_append(s["out"], out).alias("out"))

    done = script.select(video, F.explode(F.aggregate("_s", begin, step, lambda s: s["out"])).alias("_o")).select(video, F.col("_o._place").alias(place), "_o.direction")
    return scenes.join(done, [video, place])


def video_labels(frames: DataFrame, video: str, place: str, most: int = 12) -> DataFrame:
    """One row a video from its frames (video, place, labels, description, subject,
    overlay, cut): the labels of all frames in order, one for each folded spelling;
    description and subject of the middle frame, else of the first that has one; and
    ``rejected``: a cut of which any frame has an overlay in its middle."""
    from .library import label_hygiene

    n = Window.partitionBy(video)
    rows = frames.withColumn("_i", F.row_number().over(n.orderBy(place)) - 1).withColumn("_mid", F.col("_i") == F.floor(F.count("*").over(n) / 2))
    full = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    first = lambda c: F.min_by(c, F.when(full(c), F.struct(~F.col("_mid"), "_i")))
    merged = rows.groupBy(video).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "labels"))), lambda s: F.coalesce(s["labels"], F.array().cast("array<string>"))).alias("_l"), first("description").alias("description"), first("subject").alias("subject"), F.bool_or(F.col("cut") & F.col("overlay")).alias("rejected"))
    clean = label_hygiene(merged.select(video, F.flatten("_l").alias("_l")), video, "_l", most)
    return merged.drop("_l").join(clean, video, "left").select(video, F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("rejected", F.lit(False)).alias("rejected"))

