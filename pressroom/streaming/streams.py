"""Structured Streaming twins of the desk's polling loops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import drop_folder, shared_folder


def file_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream over the Parquet files at ``path`` (a folder or one file)."""
    return spark.readStream.schema(like.schema).parquet(path[:-1] + "[" + path[-1] + "]")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it put out: rows of the
    last state in update and complete mode (``folder`` holds sink and checkpoint)."""
    spark, out = stream.sparkSession, f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def peek(stream: DataFrame, folder: str) -> DataFrame:
    """What ``drain`` with the same folder would bring next, without moving its cursor: the
    stream is run from a copy of the checkpoint, which is dropped again."""
    spark = stream.sparkSession
    side, path = shared_folder(spark, "peek"), spark._jvm.org.apache.hadoop.fs.Path
    conf, own, copy = spark._jsc.hadoopConfiguration(), path(f"{folder}/checkpoint"), path(f"{side}/checkpoint")
    fs = own.getFileSystem(conf)
    if fs.exists(own):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, own, copy.getFileSystem(conf), copy, False, conf)
    out = f"{side}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{side}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).start().awaitTermination()
    drop_folder(spark, f"{side}/checkpoint")
    found = path(out)
    return spark.read.schema(stream.schema).parquet(out) if fs.exists(found) else spark.createDataFrame([], stream.schema)


def daily_counts(rows: DataFrame, ts: str, late: str = "72 hours") -> DataFrame:
    """Tumbling days; a day is final when the watermark passes it."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("w.start").alias("day"), "event_type", "n", "most")


def freshness(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.window(ts, "6 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def inbox(rows: DataFrame, room: int) -> DataFrame:
    """Messages of one room that are not empty."""
    return rows.filter((F.col("user_id") % 10 == room) & (F.col("props") != "{}"))


def distinct_items(rows: DataFrame, key: list[str], ts: str, late: str = "72 hours") -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def done_counter(rows: DataFrame) -> DataFrame:
    """Cumulative finished jobs, not who is finished just now."""
    return rows.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("done"))


def latest_per_id(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max(F.struct(order, *fields)).alias("l")).select(key, *[F.col(f"l.{f}").alias(f) for f in (order, *fields)])


def stage_clock(rows: DataFrame, done: str = "purchase") -> DataFrame:
    """(user_id, stage, micros) whenever a job's clock changes: the first start counts,
    of the ``done`` stage the last finish."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, stamps = (list(x) for x in state.get) if state.exists else ([], [])
        clock, before = dict(zip(names, stamps)), dict(zip(names, stamps))
        for pdf in batches:
            for stage, t in pdf[["event_type", "t"]].itertuples(index=False):
                clock[stage] = t if stage not in clock else max(clock[stage], t) if stage == done else min(clock[stage], t)
        state.update((list(clock), list(clock.values())))
        changed = [(key[0], s, t) for s, t in clock.items() if before.get(s) != t]
        yield pd.DataFrame(changed, columns=["user_id", "stage", "micros"])

    timed = rows.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, stage string, micros long", "names array<string>, stamps array<long>", "update", GroupStateTimeout.NoTimeout)


def overdue(rows: DataFrame, hours: int = 24) -> DataFrame:
    """An alert for each job that was rendered (purchase) and not filed (signup) within
    ``hours``, by an event-time timer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (rendered,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], rendered)], columns=["user_id", "rendered"])
            return
        last = -1
        filed = -1
        for pdf in batches:
            for kind, t in pdf[["event_type", "t"]].itertuples(index=False):
                if kind == "purchase":
                    last = max(last, t)
                elif kind == "signup":
                    filed = max(filed, t)
        rendered = max(last, state.get[0] if state.exists else -1)
        if filed >= rendered and state.exists:
            state.remove()
        elif rendered > filed:
            state.update((rendered,))
            state.setTimeoutTimestamp(max(rendered // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    timed = rows.select("user_id", "event_type", "ts", F.unix_micros("ts").alias("t")).withWatermark("ts", "1 hour")
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, rendered long", "rendered long", "append", GroupStateTimeout.EventTimeTimeout)
