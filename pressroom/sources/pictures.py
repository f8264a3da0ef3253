"""Pictures as rows: Spark's image source decodes them, and each becomes three difference
hashes - of the whole, and of a strip at the top and one at the bottom, which a cut at
the other end leaves alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["origin", "height", "width", "nChannels", "data"]


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, nChannels, data) of what can be decoded below ``path``;
    files that cannot are left out. Channels are blue, green, red, as Spark has them."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return rows.select(*[f"image.{f}" for f in FIELDS])


def difference_hashes(pictures: DataFrame, strip: float = 0.5, least: int = 8) -> DataFrame:
    """(origin, bits, top, bottom): a bit says that a pixel of the picture, shrunk to 9 x 8
    grey ones by area means, is brighter than its right neighbour; row by row, the first bit
    the highest. A strip is as wide as the picture and ``strip`` times its width high
    (``least`` pixels at least, the whole picture at most). Pictures without pixels have
    nulls."""

    def run(batches):
        import numpy as np
        import pandas as pd

        def shares(n: int, cells: int) -> np.ndarray:
            """What part of each of n pixels lies in each of the cells."""
            edge = np.linspace(0, n, cells + 1)
            at = np.arange(n)
            return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * (cells / n)

        def bits(grey: np.ndarray) -> int:
            small = np.round(shares(grey.shape[0], 8) @ grey @ shares(grey.shape[1], 9).T, 9)
            value = int("".join("1" if x else "0" for x in (small[:, :-1] > small[:, 1:]).ravel()), 2)
            return value - (1 << 64) if value >> 63 else value

        for pdf in batches:
            out = []
            for origin, h, w, c, data in pdf[FIELDS].itertuples(index=False):
                if not data or h <= 0 or w <= 0:
                    out.append((origin, None, None, None))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
                grey = pixels[:, :, 0] if c == 1 else pixels[:, :, :3] @ (0.114, 0.587, 0.299)
                high = min(h, max(least, int(w * strip)))
                out.append((origin, bits(grey), bits(grey[:high]), bits(grey[h - high :])))
            yield pd.DataFrame(out, columns=["origin", "bits", "top", "bottom"]).astype({c: "Int64" for c in ("bits", "top", "bottom")})

    return pictures.select(*FIELDS).mapInPandas(run, "origin string, bits long, top long, bottom long")


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    return difference_hashes(read_pictures(spark, path))


def colour_profile(pixels: DataFrame, key: str, top: int = 8, sharp: int = 120) -> DataFrame:
    """(key, share, edges, graphic) of pictures given as pixels (key, x, y, r, g, b):
    ``share`` of the ``top`` commonest of the 8 x 8 x 8 colours, ``edges``: the share of
    inner pixels whose grey changes by more than ``sharp`` across them (left to right plus
    top to bottom), null without inner pixels. A graphic has 80 % in its commonest colours,
    or 65 % and sharp edges at 7 % of the pixels, or 55 % and 10 %."""
    from pyspark.sql import Window

    colour = F.floor(F.col("r") / 32) * 64 + F.floor(F.col("g") / 32) * 8 + F.floor(F.col("b") / 32)
    bins = pixels.groupBy(key, colour.alias("colour")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "colour"))  # 512 colours at most
    share = bins.withColumn("_r", rank).groupBy(key).agg((F.sum(F.when(F.col("_r") <= top, F.col("n"))) / F.sum("n")).alias("share"))
    grey = F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000)
    across, down = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    g = pixels.select(key, "x", "y", grey.alias("g"))
    g = g.withColumn("_w", F.lead("g").over(across) - F.lag("g").over(across)).withColumn("_h", F.lead("g").over(down) - F.lag("g").over(down))
    edges = g.filter("_w IS NOT NULL AND _h IS NOT NULL").groupBy(key).agg((F.count_if(F.abs("_w") + F.abs("_h") > sharp) / F.count("*")).alias("edges"))
    rows = share.join(edges, key, "left")
    sharp_enough = F.coalesce("edges", F.lit(0.0)) >= F.when(F.col("share") >= 0.65, 0.07).otherwise(0.10)
    return rows.withColumn("graphic", (F.col("share") >= 0.80) | ((F.col("share") >= 0.55) & sharp_enough))
