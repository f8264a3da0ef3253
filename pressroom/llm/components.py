"""Connected components of an edge table by alternating large-star and small-star
steps. Every step is a grouped minimum and a join; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) in any order, repeats and loops allowed. Returns (node, label)
    for every node that is not the least of its component; label is the least."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = as_table(edges.filter("a <> b").select(u, v).distinct(), "links")
    for _ in range(most_rounds):
        # Done when every node hangs on one node that hangs on none.
        parents = now.select(F.col("v").alias("u")).distinct().join(now, "u", "left_semi").limit(1).count()
        if not parents and not now.groupBy("u").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = as_table(small, "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
