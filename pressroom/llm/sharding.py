"""Weighted rendezvous hashing of record keys.

Each (key, shard) pair has a hash u in (0, 1); the record goes to the shard with the
greatest -weight / ln(u). A shard's score does not depend on the other shards, so a
new shard takes records only into itself, about weight / total weight of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number of ``key``; shards of weight 0 get nothing. Equal keys, null
    included, share a shard."""
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000null")), F.lit(f"shard-{shard}")), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("n")))
    if not scores:
        raise ValueError("no shard has a weight above 0")
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["n"]).cast("int")


def slots(rows: DataFrame, shard: str, order: list[str], row: str, bucket_rows: int = 200_000) -> DataFrame:
    """Adds slot: places 0, 1, 2, ... in each shard. A shard is numbered bucket by
    bucket: buckets are counted, the counts summed up per shard, and each bucket is
    sorted on its own, so that no task sees a whole shard. The number of buckets grows
    with the rows. Rows alike in ``order`` share a bucket; more than ``bucket_rows`` of
    them are dealt by ``row``, a number of each row, to parts of it."""
    buckets = max(512, rows.count() // bucket_rows)
    many = rows.groupBy(*order).agg(F.count("*").alias("_n")).filter(F.col("_n") > bucket_rows)
    many = as_table(many.select(*[F.col(c).alias(f"_{c}") for c in order], F.ceil(F.col("_n") / bucket_rows).alias("_parts")), "repeated-rows")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
    part = F.coalesce(F.pmod(F.xxhash64(row), F.col("_parts")) + 1, F.lit(0)).alias("_part")
    cut = rows.join(many, same, "left").select(*rows.columns, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int").alias("_bucket"), part)
    place = [shard, "_bucket", "_part"]
    running = Window.partitionBy(shard).orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy(*place).agg(F.count("*").alias("_n")).select(*place, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_base"))
    placed = cut.withColumn("_row", F.row_number().over(Window.partitionBy(*place).orderBy(*order)) - 1).join(bases, place)
    return placed.withColumn("slot", (F.col("_base") + F.col("_row")).cast("long")).drop("_bucket", "_part", "_row", "_base")


def shard_documents(docs: DataFrame, weights: list[float] | None = None, grown: list[float] | None = None, key: str = "doc_id", text: str = "text", bucket_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; ``grown``
    are the weights after the change. A null text has size 1 and the checksum of the
    empty text; repeated keys share a shard and get slots of their own; an empty table
    gives no rows; other columns are not read."""
    weights = weights or [1.0] * 8
    grown = grown or [*weights, 1.0]
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = slots(as_table(rows, "shards"), "shard", ["doc_id", "text_crc32", "size"], "row", bucket_rows)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
