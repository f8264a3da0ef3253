"""Ledgers, documents, feeds, pages and listings as DataFrames; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text

BLOCKS = ["script", "style", "nav", "footer", "header", "aside"]


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are left out."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def read_docs(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One JSON document per file; the folder names give the day and the video."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    p = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(p, "/(\\d{4}-\\d{2}-\\d{2})/", 1).alias("day"), F.regexp_extract(p, "/(video-\\d+[^/]*)/", 1).alias("video"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS and Atom in one table: title, stamp, link, file. Entries without a title are
    dropped; a broken file gives no rows."""

    def one(tag: str, fields: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("mode", "DROPMALFORMED").schema(fields).load(path)

    file = F.col("_metadata.file_path").alias("file")
    items = one("item", "title string, pubDate string, published string, link string").select("title", F.coalesce("pubDate", "published").alias("stamp"), "link", file)
    entries = one("entry", "title string, published string, updated string, link struct<_href: string>").select("title", F.coalesce("published", "updated").alias("stamp"), F.col("link._href").alias("link"), file)
    rows = items.unionByName(entries)
    return rows.withColumn("title", clean_text(F.col("title"))).filter("title <> ''")


def article_text(html: Column, limit: int = 6000, least: int = 120) -> Column:
    """Plain text of the longest <article> with enough words, else of the page."""
    bare = html
    for tag in BLOCKS:
        bare = F.regexp_replace(bare, f"(?is)<{tag}\\b.*?</{tag}>", " ")

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), "&[#a-zA-Z0-9]+;", " "), "\\s+", " "))

    found = F.transform(F.regexp_extract_all(bare, F.lit("(?is)<article\\b[^>]*>(.*?)</article>"), F.lit(1)), plain)
    good = F.filter(found, lambda a: F.size(F.split(a, " ")) >= least)
    longest = F.array_max(F.transform(good, lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))["a"]
    return F.substring(F.coalesce(longest, plain(bare)), 1, limit)


def article_links(pages: DataFrame, key: str, html: str, pattern: str, junk: str, most: int = 25) -> DataFrame:
    """(key, url, place): links of a page in first-seen order, junk left out."""
    urls = F.transform(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    each = pages.select(key, F.posexplode(urls).alias("pos", "url")).filter(~F.col("url").rlike(junk))
    first = each.groupBy(key, "url").agg(F.min("pos").alias("pos"))
    lists = first.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "url"))), 1, most).alias("l"))
    return lists.select(key, F.posexplode("l").alias("place", "u")).select(key, F.col("u.url").alias("url"), "place")


#: Fixed value: parts of an address that is no picture of the article.
JUNK = "logo|icon|avatar|sprite|banner|ads?|quangcao|placeholder|blank|1x1|spacer|favicon|thumb_w/(4|6|8)\\d|/\\d{2}x\\d{2}/|author|tacgia|share|social"


def article_image_urls(pages: DataFrame, key: str, html: str, junk: str = JUNK, most: int = 25) -> DataFrame:
    """(key, url, place): addresses of a page's pictures in first-seen order: data-src,
    data-original and src attributes with the ending of a picture, in the first <article>
    or else the whole page, then the page's og:image; junk left out, at most ``most``."""
    area = F.regexp_extract(html, "(?is)<article[^>]*>(.*?)</article>", 1)
    area = F.when(F.col(html).rlike("(?is)<article[^>]*>.*?</article>"), area).otherwise(F.col(html))
    own = F.regexp_extract_all(area, F.lit("(?:data-src|data-original|src)=[\"']?(https?://[^\"'\\s>]+\\.(?:jpg|jpeg|png|webp)[^\"'\\s>]*)"), F.lit(1))
    shared = F.regexp_extract_all(F.col(html), F.lit("<meta[^>]+property=[\"']og:image[\"'][^>]+content=[\"']([^\"']+)"), F.lit(1))
    urls = F.transform(F.concat(own, shared), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    kept = F.slice(F.array_distinct(F.filter(urls, lambda u: ~u.rlike(f"(?i)({junk})"))), 1, most)
    return pages.select(key, F.posexplode(kept).alias("place", "url")).select(key, "url", "place")


def image_table(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Pictures of a page with caption: figcaption, else alt, else title; the largest of
    a source set; icons and logos left out."""
    tags = F.regexp_extract_all(F.col(html), F.lit("(?is)(<figure\\b.*?</figure>|<img\\b[^>]*>)"), F.lit(1))
    t = pages.select(key, F.posexplode(tags).alias("pos", "tag"))

    def attribute(name: str) -> Column:
        return F.nullif(F.regexp_extract("tag", f'(?is)<img\\b[^>]*?\\b{name}="([^"]*)"', 1), F.lit(""))

    wide = F.array_max(F.transform(F.split(attribute("srcset"), ","), lambda s: F.struct(F.regexp_extract(s, "(\\d+)w", 1).try_cast("int").alias("w"), F.regexp_extract(s, "^\\s*(\\S+)", 1).alias("u"))))["u"]
    caption = F.coalesce(F.nullif(F.trim(F.regexp_extract("tag", "(?is)<figcaption[^>]*>(.*?)</figcaption>", 1)), F.lit("")), attribute("alt"), attribute("title"))
    rows = t.select(key, "pos", F.coalesce(wide, attribute("data-src"), attribute("src")).alias("url"), F.substring(caption, 1, 300).alias("caption"))
    return rows.filter("url IS NOT NULL").filter(~F.lower("url").rlike("\\.svg|\\.gif|sprite|logo|icon|avatar|placeholder"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) below a folder; file contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.filter(~name.rlike("^\\._|^\\.DS_Store$|^Thumbs\\.db$")).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def listing(rows: DataFrame, path: str, size: str, most: int) -> DataFrame:
    """The same rules over a listing table: no OS files, no oversized videos."""
    name = F.element_at(F.split(path, "/"), -1)
    video = F.lower(path).rlike("\\.(mp4|mov|mkv)$")
    return rows.filter(~name.rlike("^\\._|^\\.DS_Store$|^Thumbs\\.db$") & ~(video & (F.col(size) > most)))


def write_day(board: DataFrame, path: str, day: str = "day") -> None:
    """One partition per day; only the days at hand are overwritten."""
    board.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
