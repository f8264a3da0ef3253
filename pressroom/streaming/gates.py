"""Gates of the desk's polling loops as streams. What a gate remembers lies in versions,
one for each micro-batch, below a folder of its own: a batch that is run again after a
failure reads the version before it and overwrites its own, so nothing counts twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.board import stored


def _version(spark: SparkSession, folder: str, n: int, schema: str) -> DataFrame:
    """The newest version below batch ``n`` (an empty batch may have left none)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()[1:]) for s in (fs.listStatus(path) if fs.exists(path) else []) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    older = [v for v in found if v < n]
    return spark.read.schema(schema).parquet(f"{folder}/v{max(older)}") if older else spark.createDataFrame([], schema)


def _run(stream: DataFrame, folder: str, step) -> None:
    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


# ------------------------------------------------------------------ listings
_MARKS = "root string, scan long, n long, h decimal(38,0), total long, trusted boolean"


def trusted_scans(stream: DataFrame, folder: str) -> DataFrame:
    """(root, scan) of all scans that can be trusted: a listing is, once it is the same as
    the scan before. The stream brings the rows (root, scan, path, size, total) of scans,
    ``total`` saying how many a scan of the root has; a scan may come in several batches,
    scans of many roots side by side. Scans are compared by count and an order-free hash.

    Call it whenever there is something new: it goes on from the checkpoint below
    ``folder``. Of each root only the marks from its last complete scan on are kept, and
    the trusted ones."""
    spark, marks = stream.sparkSession, f"{folder}/marks"

    def step(batch: DataFrame, n: int) -> None:
        own = spark.createDataFrame([], _MARKS) if batch.isEmpty() else batch.groupBy(F.col("root").cast("string").alias("root"), F.col("scan").cast("long").alias("scan")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "size").cast("decimal(38,0)")).cast("decimal(38,0)").alias("h"), F.max("total").cast("long").alias("total"), F.lit(False).alias("trusted"))
        every = _version(spark, marks, n, _MARKS).unionByName(own)
        merged = every.groupBy("root", "scan").agg(F.sum("n").alias("n"), F.sum("h").cast("decimal(38,0)").alias("h"), F.max("total").alias("total"), F.bool_or("trusted").alias("trusted"))
        whole = merged.withColumn("whole", F.col("n") == F.col("total"))
        before = whole.filter("whole").select("root", (F.col("scan") + 1).alias("scan"), F.col("n").alias("_n"), F.col("h").alias("_h"))
        last = whole.filter("whole").groupBy("root").agg(F.max("scan").alias("_last"))
        judged = whole.join(before, ["root", "scan"], "left").join(last, "root", "left")
        trusted = F.col("trusted") | F.coalesce(F.col("whole") & (F.col("n") == F.col("_n")) & (F.col("h") == F.col("_h")), F.lit(False))
        kept = judged.withColumn("trusted", trusted).filter(F.col("trusted") | (F.col("scan") >= F.coalesce("_last", F.lit(-1))))
        kept.select("root", "scan", "n", "h", "total", "trusted").write.mode("overwrite").parquet(f"{marks}/v{n}")

    _run(stream, folder, step)
    return _version(spark, marks, 1 << 62, _MARKS).filter("trusted").select("root", "scan")


def stable_listing(listing: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of each root's newest trusted scan."""
    newest = trusted.groupBy("root").agg(F.max("scan").alias("scan"))
    return listing.join(newest, ["root", "scan"], "left_semi")


# ------------------------------------------------------------------ files
def content_gate(files: DataFrame, known: DataFrame, keys: list[str], order: str, most_rounds: int = 1000) -> DataFrame:
    """The files that are let in, as if one came after the other in the order of
    ``order`` (unique): a file is refused if one already known or let in before it agrees
    in any of ``keys`` (path, then size, then checksum); nulls agree with nothing.

    In a round the files that come first among the open ones in each of their keys are let
    in, and what agrees with them goes; a key's group is reduced to its minimum, so a
    checksum that many share is one row. Rounds are as many as the longest chain of
    files that agree in different keys."""
    open_ = files
    for k in keys:
        open_ = open_.join(known.filter(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    columns, done = files.columns, None
    open_ = stored(open_.select(*columns))
    for _ in range(most_rounds):
        if open_.isEmpty():
            return done if done is not None else open_
        first = open_
        for i, k in enumerate(keys):
            least = open_.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_m{i}"))
            first = first.join(least, k, "left").filter(F.coalesce(F.col(f"_m{i}") == F.col(order), F.lit(True)))
        first = stored(first.select(*columns))
        done = first if done is None else done.unionByName(first)
        rest = open_.join(first.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(first.filter(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        open_ = stored(rest.select(*columns))
    raise RuntimeError(f"files did not settle in {most_rounds} rounds")


def file_gate(stream: DataFrame, folder: str, keys: list[str], order: str) -> DataFrame:
    """The ledger of files let in so far by ``content_gate`` over a stream of files; it
    goes on from the checkpoint below ``folder``. A file that is delivered again finds
    itself in the ledger."""
    spark, ledger = stream.sparkSession, f"{folder}/ledger"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def before(n: int) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName()[6:]) for s in (fs.listStatus(path) if fs.exists(path) else [])]
        own = [f"{ledger}/batch={v}" for v in found if v < n]
        return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)

    def step(batch: DataFrame, n: int) -> None:
        content_gate(batch, before(n), keys, order).write.mode("overwrite").parquet(f"{ledger}/batch={n}")

    _run(stream, folder, step)
    return before(1 << 62)


# ------------------------------------------------------------------ feeds
def freshness(age: Column) -> Column:
    """Points for an age in hours: 25 to 6 h, 15 to 12 h, 8 to 24 h, 0 beyond."""
    return F.when(age <= 6, 25).when(age <= 12, 15).when(age <= 24, 8).otherwise(0)


def staleness(age: Column) -> Column:
    """What the heat of old news is multiplied by: 1 to 36 h, 0.7 to 72 h, 0.45 beyond."""
    return F.when(age > 72, 0.45).when(age > 36, 0.7).otherwise(1.0)


def band(age: Column) -> Column:
    """The band of an age: 6, 12, 24, 36 or 72 hours, else 999."""
    return F.when(age <= 6, 6).when(age <= 12, 12).when(age <= 24, 24).when(age <= 36, 36).when(age <= 72, 72).otherwise(999)


def board_items(stream: DataFrame, items: DataFrame, folder: str, key: list[str], ts: str, now: Column, late: str = "72 hours", unknown: float = 999.0) -> DataFrame:
    """Every item of a feed once, with its age in hours, band, points and factor.

    The stream passes on first sightings whose stamp the watermark has not left behind;
    items of ``items`` (the same rows, as a table) that it did not pass on came too late
    or have no stamp that could be read. Those are not dropped but come from the batch
    side, where their age scores them down (no stamp: age ``unknown``). An item seen more
    than once has its newest stamp, whichever side it came from."""
    spark, out = stream.sparkSession, f"{folder}/out"
    fresh = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    query = fresh.select(*key, ts).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    seen = spark.read.schema(fresh.select(*key, ts).schema).parquet(out).withColumn("late", F.lit(False))
    missed = items.select(*key, ts).join(seen.select(*key).distinct(), key, "left_anti").withColumn("late", F.lit(True))
    again = items.select(*key, ts).join(seen.select(*key).distinct(), key, "left_semi").withColumn("late", F.lit(False))
    rows = seen.unionByName(again).unionByName(missed).groupBy(*key).agg(F.max(ts).alias(ts), F.bool_and("late").alias("late"))
    hours = (F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3.6e9
    age = F.when(F.col(ts).isNull(), unknown).otherwise(hours)
    return rows.withColumn("age", age).select(*key, "late", "age", band(F.col("age")).alias("band"), freshness(F.col("age")).alias("points"), staleness(F.col("age")).alias("factor"))
