"""Mixing sources to target word counts by weighted sampling without replacement.

Every document has the key -ln(u) / weight (Efraimidis and Spirakis: taking keys in
ascending order is sampling without replacement in proportion to the weights). A
source's target is filled by complete epochs of all its documents first; what is
left is filled with whole documents in key order until the running word count
reaches the budget. The running count is found in two steps, over buckets of keys and
then only inside the one bucket per source in which the budget ends, so no task
sorts a whole source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """``sources`` (source, source_size) with target. Sources in code point order,
    null last, have the weights in turn and share ``share`` times all words; no target
    is above ``cap`` times its source's size, the excess goes to the others by weight.

    With caps in order of cap / weight, the level at which the rest shares by weight is
    the first that its own caps do not cut; there is one row per source."""
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weighted = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int")))
    capped = weighted.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - before) / after
    levels = capped.withColumn("_level", level)
    fits = F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))
    chosen = levels.withColumn("_share", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return chosen.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_share") * F.col("_w"), F.col("_cap"))).alias("target"))


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(doc_id, quality): sampling weights from 0/1 quality labels; repeated labels of
    a document are averaged."""
    seen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    return seen.select("doc_id", (F.lit(bad) + (good - bad) * F.col("q")).alias("quality"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: list[float] | None = None, share: float = 1.5, cap: float = 2.0, seed: int = 0, bucket_rows: int = 200_000, key: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of this row, with
    repeats) and copies of every row of ``docs``.

    Columns named in ``carry`` come along as they are. ``quality``
    has one positive weight per (doc_id, quality); documents that it lacks, or whose
    weight is not positive, weigh 1. The
    draw depends on the key, the text and the seed alone, so reruns agree; rows that
    are repeated in full stand next to each other in the order. A null text has size 0;
    null sources are one source, the last; a source without words has target 0; an
    empty table gives no rows."""
    weights = weights or [5.0, 2.0, 1.0]
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("\u0000null")), F.coalesce(F.xxhash64(text), F.lit(0))), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    kept = [F.col(f"`{c}`").alias(f"kept_{c}") for c in carry]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"), *kept)
    w = F.lit(1.0)
    if quality is not None:  # the texts are counted by now and need not move
        rows = rows.join(quality.select("doc_id", F.col("quality").cast("double").alias("w")), "doc_id", "left")
        w = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    rows = rows.withColumn("draw", -F.log("u") / w).drop("u", "w")
    # Ascending in the key; for equal weights the buckets are about equally full, and their
    # number, which changes nothing in the draw, grows with the rows.
    buckets = max(512, docs.select(key).count() // bucket_rows)
    rows = as_table(rows.withColumn("bucket", F.floor(F.lit(buckets) * (1 - F.exp(-F.col("draw")))).cast("int")), "mix-keys")

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(running), F.lit(0)))
    # The bucket in which the budget ends: the last that starts below it.
    ends = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).filter((F.col("base") < F.col("rest")) & (F.col("n") > 0))
    ends = ends.groupBy(F.col("b.source").alias("source")).agg(F.max(F.struct("bucket", "base")).alias("e")).select("source", F.col("e.bucket").alias("last"), F.col("e.base").alias("base"))
    plan = plan.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("base", F.lit(0)).alias("base"))
    plan = as_table(plan, "mix-plan")

    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", *[F.col(f"p.{c}") for c in ("source_size", "target", "epochs", "rest", "last", "base")])
    whole = joined.filter("bucket <> last").withColumn("picked", F.col("bucket") < F.col("last"))
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("base") + F.sum("size").over(order) - F.col("size") / 2.0  # a document straddling the end counts if most of it fits
    cut = joined.filter("bucket = last").withColumn("picked", middle <= F.col("rest"))
    copies = F.col("epochs") + F.col("picked").cast("int")
    return whole.unionByName(cut).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), *[F.col(f"`kept_{c}`") for c in carry])
