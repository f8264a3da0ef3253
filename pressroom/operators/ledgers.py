"""Folding, auditing and reporting on append-only ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_match


def fold(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Later rows override earlier ones field by field; a field that is absent (null)
    overrides nothing. Rows without a key are dropped. One partial aggregation."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def upper_median(rows: DataFrame, group: str, value: str, bins: int = 4096) -> DataFrame:
    """sorted[n // 2] of each group, exact. Values are counted in bins between a group's
    least and greatest; only the distinct values of the bin with the middle one are put in
    order, so a group may hold most of the rows. NaN counts as the greatest number. Null
    groups are one."""
    good = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    x = F.when(F.isnan(F.col("_v").cast("double")), float("inf")).otherwise(F.col("_v").cast("double"))
    finite = F.when(F.abs(x) < float("inf"), x)
    ends = good.groupBy("_g").agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count("*").alias("_n")).withColumnRenamed("_g", "_h")
    place = F.when(x == float("inf"), bins + 1).when(x == float("-inf"), -1).when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    binned = good.join(ends, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", "_n", place.cast("int").alias("_b"))
    below = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    sizes = binned.groupBy("_g", "_b", "_n").agg(F.count("*").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(below), F.lit(0)))
    middle = F.floor(F.col("_n") / 2)
    target = sizes.filter((F.col("_base") <= middle) & (middle < F.col("_base") + F.col("_c"))).select(F.col("_g").alias("_h"), F.col("_b").alias("_t"), "_base")
    values = binned.join(target, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_t"))).groupBy("_g", "_n", "_base", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_v"))
    ranked = values.withColumn("_upto", F.col("_base") + upto)
    return ranked.filter((middle < F.col("_upto")) & (middle >= F.col("_upto") - F.col("_c"))).select(F.col("_g").alias(group), F.col("_v").alias("median"), F.col("_n").alias("n"))


def stage_durations(rows: DataFrame, job: str, stage: str, ts: str, stages: list[str], done: list[str], least: float = 0.5) -> DataFrame:
    """Seconds between consecutive existing stages of a job. The first record of a stage
    counts, of the ``done`` stages the last; negative spans are 0, short ones dropped."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage))
    at = rows.filter(F.col(stage).isin(*stages)).groupBy(job, stage).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    at = at.select(job, stage, place.alias("place"), F.when(F.col(stage).isin(*done), F.col("last")).otherwise(F.col("first")).alias("at"))
    w = Window.partitionBy(job).orderBy("place")
    spans = at.select(job, F.col(stage).alias("stage"), F.lead(stage).over(w).alias("next"), F.greatest(F.lit(0.0), (F.unix_micros(F.lead("at").over(w).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6).alias("seconds"))
    kept = spans.filter(F.col("next").isNotNull() & (F.col("seconds") >= least))
    return kept.withColumn("percent", F.round(100 * F.col("seconds") / F.sum("seconds").over(Window.partitionBy(job)), 4))


def mirror_diff(local: DataFrame, remote: DataFrame, last: DataFrame, share: float = 0.15, many: int = 20, least: int = 50, first_run: bool = False, force: bool = False) -> DataFrame:
    """Actions that make two listings (path, size) agree, given the paths that were in
    both before: push where sizes differ, pull or delete what is on one side only.
    Brakes: a first run pulls nothing; too many pulls or deletions are refused."""
    l, r, b = local.select("path", F.col("size").alias("ls")), remote.select("path", F.col("size").alias("rs")), last.select("path", F.lit(True).alias("known"))
    both = l.join(r, "path", "full_outer").join(b, "path", "left")
    here, there, known = F.col("ls").isNotNull(), F.col("rs").isNotNull(), F.coalesce("known", F.lit(False))
    action = F.when(here & there & (F.col("ls") != F.col("rs")), "push").when(here & ~there & known, "delete_local").when(here & ~there, "push").when(there & ~here & known, "delete_remote").when(there & ~here, "pull")
    acts = both.select("path", action.alias("action"), here.alias("here"), there.alias("there"))
    n = acts.agg(F.count_if("here").alias("nl"), F.count_if("there").alias("nr"), F.count_if(F.col("action") == "pull").alias("pulls"), F.count_if(F.col("action").startswith("delete")).alias("dels"))
    braked = acts.filter("action IS NOT NULL").crossJoin(n)  # one row of totals
    total = F.greatest("nl", "nr")
    no_pull = F.lit(first_run) | ((F.col("pulls") > share * total) & (F.col("pulls") > many))
    no_delete = (F.least("nl", "nr") < least) | (F.col("dels") > share * total)
    refused = F.when(F.lit(force), False).when(F.col("action") == "pull", no_pull).when(F.col("action").startswith("delete"), no_delete).otherwise(False)
    return braked.select("path", "action", refused.alias("refused"))


def upsert(ledger: DataFrame, changes: DataFrame, key: str, fields: list[str], order: str | None = None, given: str | None = None) -> DataFrame:
    """The ledger with changes applied and new keys appended; changes without a key are
    dropped. A field of a change counts if it is not null, or, where ``given`` names a
    column with the names of the fields a change brings, if it is among them: then a null
    is a value, too. Several changes of one key are applied in the order of ``order``
    (unique within a key); without it a key must not change twice."""
    rows = changes.filter(F.col(key).isNotNull())
    has = {f: F.coalesce(F.array_contains(given, f), F.lit(False)) if given else F.col(f).isNotNull() for f in fields}
    if order:
        c = rows.groupBy(key).agg(*[F.max_by(f, F.when(has[f], F.col(order))).alias(f"_{f}") for f in fields], *[F.bool_or(has[f]).alias(f"_has_{f}") for f in fields])
    else:
        c = rows.select(key, *[F.col(f).alias(f"_{f}") for f in fields], *[has[f].alias(f"_has_{f}") for f in fields])
    return ledger.select(key, *fields).join(c, key, "full_outer").select(key, *[F.when(F.coalesce(f"_has_{f}", F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def fold_lines(lines: DataFrame, line: str, order: str, key: str, fields: list[str]) -> DataFrame:
    """``fold`` over JSON lines, told apart by what a line names: a field that a line gives
    as null overrides, one that it does not name does not. All values are strings."""
    body = lines.select(F.from_json(line, "map<string,string>").alias("_m"), order)
    id_ = F.try_element_at("_m", F.lit(key))
    rows = body.select(id_.alias(key), order, "_m").filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*[F.max_by(F.try_element_at("_m", F.lit(f)), F.when(F.map_contains_key("_m", f), F.col(order))).alias(f) for f in fields])


def precedence_merge(machine: DataFrame, human: DataFrame, key: list[str], value: str) -> DataFrame:
    """Human values win where they are given (not empty), machine values fill the rest."""
    h = human.select(*key, F.col(value).alias("_h"))
    merged = machine.select(*key, F.col(value).alias("_m")).join(h, key, "full_outer")
    given = F.col("_h").isNotNull() & (F.col("_h") != "")
    return merged.select(*key, F.when(given, F.col("_h")).otherwise(F.col("_m")).alias(value), F.when(given, "human").otherwise("machine").alias("origin"))


def retention(jobs: DataFrame, files: DataFrame, job: str, published: str, created: str, now: Column, days: int = 7) -> DataFrame:
    """Per job the bytes, the bytes that can go and the decision: published jobs older
    than ``days`` give up the files that are not in use."""
    sums = files.groupBy(job).agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("used"), 0).otherwise(F.col("bytes"))).alias("idle"))
    old = F.datediff(now, F.col(created)) > days
    decision = F.when(~F.col(published), "keep").when(~old, "wait").otherwise("clean")
    joined = jobs.join(sums, job, "left").withColumn("decision", decision)
    return joined.select(job, F.coalesce("bytes", F.lit(0)).alias("bytes"), F.when(F.col("decision") == "clean", F.coalesce("idle", F.lit(0))).otherwise(0).alias("reclaimable"), "decision")


def audit_progress(rows: DataFrame, level: str, confidence: str) -> DataFrame:
    """Counts per eye level, per confidence and in all, in one pass."""
    return rows.rollup(level, confidence).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def worklist(rows: DataFrame, level: Column, mine: int, approved: Column, rough: Column, force: bool = False) -> DataFrame:
    """Rows still to be audited: not approved by a human, not rough, seen by a lesser eye."""
    return rows.filter(~approved & ~rough & (F.lit(force) | (level < mine)))


def prioritised(rows: DataFrame, hit: Column, order: str, most: int) -> DataFrame:
    """Rows that match come first, order kept within."""
    return rows.withColumn("_late", ~hit).orderBy("_late", order).limit(most).drop("_late")


def every_nth(rows: DataFrame, order: str, i: int, n: int) -> DataFrame:
    """Shard i of n of the worklist in order of a key of any type: by position, found
    without one big window. Rows are dealt to sorted ranges, counted per range, and numbered
    inside it. Rows without a key come first."""
    from .board import stored

    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(order).asc_nulls_first()).withColumn("_b", F.spark_partition_id())
    cut = stored(dealt)  # ranges are drawn anew whenever they are computed again
    base = cut.groupBy("_b").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy(F.col(order).asc_nulls_first())) - 1
    return cut.join(base, "_b").withColumn("_place", place).filter(F.col("_place") % n == i).drop("_b", "_base", "_place")


def soft_delete(rows: DataFrame, prints: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of a ledger without the rows of ``keys``, the rows taken out (to undo
    it), and what is left of the fingerprints (key and any columns)."""
    gone = keys.select(key).distinct()
    return rows.join(gone, key, "left_anti"), rows.join(gone, key, "left_semi"), prints.join(gone, key, "left_anti")


def reminders(jobs: DataFrame, catalog: DataFrame, now: Column, hours: int = 24, days: int = 4, most: int = 5) -> DataFrame:
    """Jobs (job, day, title, rendered, filed) of the newest ``days`` days that there are,
    rendered more than ``hours`` ago and not filed: neither by their flag nor by their
    title, compared folded by its first 60 characters, in the ``catalog`` (title); the
    newest day first, ``most`` at most. Jobs without a rendering are not due."""
    fold = lambda c: F.substring(fold_match(F.col(c)), 1, 60)
    known = catalog.select(fold("title").alias("_f")).filter("_f <> ''").distinct()
    newest = jobs.select("day").distinct().orderBy(F.desc("day")).limit(days)
    due = jobs.join(newest, "day", "left_semi").filter(~F.coalesce("filed", F.lit(False)) & (F.col("rendered") < now - F.make_interval(hours=F.lit(hours))))
    open_ = due.withColumn("_f", F.coalesce(fold("title"), F.lit(""))).join(known, "_f", "left_anti")
    return open_.orderBy(F.desc("day"), "job").limit(most).select("job", "day", "title")


def last_examples(rows: DataFrame, user: str, order: str, text: str, most: int = 14) -> DataFrame:
    """(user, order, text): of each user's last ``most`` rows the different texts, each
    where it stands first; empty ones left out."""
    r = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(order)))
    last = rows.withColumn("_r", r).filter((F.col("_r") <= most) & F.col(text).isNotNull() & (F.col(text) != ""))
    return last.groupBy(user, text).agg(F.min(order).alias(order)).select(user, order, text)


def last_edits(logs: DataFrame, user: str, order: str, changes: str, of: int = 6, each: int = 3, most: int = 8) -> DataFrame:
    """(user, place, change): the first ``each`` changes of each of a user's last ``of``
    edit logs (``changes`` is a list), of these the last ``most``, in order."""
    r = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(order)))
    last = logs.withColumn("_r", r).filter(F.col("_r") <= of)
    lists = last.groupBy(user).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, F.slice(changes, 1, each).alias("_c")))), lambda s: s["_c"])).alias("_l"))
    kept = F.slice("_l", F.greatest(F.size("_l") - most + 1, F.lit(1)), F.lit(most))
    return lists.select(user, F.posexplode(kept).alias("place", "change"))


def change_signal(rows: DataFrame, job: str, ts: str) -> DataFrame:
    return rows.groupBy(job).agg(F.count("*").alias("files"), F.max(ts).alias("newest"))
