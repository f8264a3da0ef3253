"""Sources, sinks and streams, run over the driver's tables to their end."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import library, timeline
from ..scratch import shared_folder
from ..sources import readers
from ..streaming import gates, streams
from .registry import Tables, query


def folder(t: Tables, name: str) -> str:
    return shared_folder(t.spark, name)


def events(t: Tables) -> DataFrame:
    """The event table as a stream."""
    rows = streams.file_stream(t.spark, f"{t.folder}/events.parquet", t.events)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3")
def src1_read_ledger(t: Tables) -> DataFrame:
    path = folder(t, "ledger")
    line = F.when(F.col("event_id") % 10 == 3, "{broken").otherwise(F.to_json(F.struct("event_id", "user_id", "event_type", "value")))
    t.events.select(line.alias("value")).write.text(path)
    return readers.read_ledger(t.spark, path, "event_id long, user_id long, event_type string")


def _unescaped_sql(c: str) -> str:
    """HTML entities decoded once, as ``unescape`` does; ``names.m`` maps names to characters."""
    digits = "regexp_extract(name, '[0-9a-fA-F]+$')"
    code = f"CASE WHEN regexp_matches(name, '^#[xX]') THEN CAST('0x' || {digits} AS BIGINT) ELSE TRY_CAST({digits} AS BIGINT) END".replace("name", "x.name")
    char = f"CASE WHEN x.name = '' THEN NULL WHEN x.name LIKE '#%' THEN CASE WHEN {code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343 THEN chr(CAST({code} AS INTEGER)) ELSE chr(65533) END ELSE m[x.name] END"
    named = f"list_transform(string_split({c}, '&')[2:], lambda s: struct_pack(s := s, name := regexp_extract(s, '^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]*);', 1)))"
    return f"string_split({c}, '&')[1] || coalesce(array_to_string(list_transform({named}, lambda x: coalesce({char} || substr(x.s, length(x.name) + 2), '&' || x.s)), ''), '')"


_ENTITIES = ", ".join("('{}', '{}')".format(k[:-1], v.replace("'", "''")) for k, v in sorted(html5.items()) if k.endswith(";"))


@query(f"""WITH names AS (SELECT map_from_entries(list((k, v))) AS m FROM (VALUES {_ENTITIES}) e(k, v)),
  a AS (SELECT page_id, m, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g') AS t FROM pages, names),
  b AS (SELECT page_id, m, {_unescaped_sql("t")} AS t FROM a), c AS (SELECT page_id, m, {_unescaped_sql("t")} AS t FROM b), d AS (SELECT page_id, {_unescaped_sql("t")} AS t FROM c)
  SELECT page_id, trim(regexp_replace(t, '[\\s\\x0B\\x{{A0}}]+', ' ', 'g')) AS title FROM d WHERE trim(regexp_replace(t, '[\\s\\x0B\\x{{A0}}]+', ' ', 'g')) <> ''""")
def src3_read_feed(t: Tables) -> DataFrame:
    path = folder(t, "feed")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    item = F.concat(F.lit("<item><title>"), F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("</title><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate><link>"), "page_id", F.lit("</link></item>"))
    entry = F.concat(F.lit("<entry><title>"), F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("</title><updated>2024-01-01T00:00:00Z</updated><link href=\""), "page_id", F.lit("\"/></entry>"))
    rows = t.pages.select(F.floor(F.col("page_id") / 16).alias("g"), F.when(F.col("page_id") % 2 == 0, item).otherwise(entry).alias("v"))
    files = rows.groupBy("g").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("v"), ""), F.lit("</feed>")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_feed(t.spark, path).select(F.col("link").cast("long").alias("page_id"), "title")


@query("""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<nav\\b.*?</nav>', ' ', 'g'), '(?is)<footer\\b.*?</footer>', ' ', 'g'), '(?is)<header\\b.*?</header>', ' ', 'g'), '(?is)<aside\\b.*?</aside>', ' ', 'g') AS h FROM pages),
  a AS (SELECT page_id, h, list_filter(list_transform(regexp_extract_all(h, '(?is)<article\\b[^>]*>(.*?)</article>', 1), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '&[#a-zA-Z0-9]+;', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: len(string_split(x, ' ')) >= 120) AS l FROM b)
  SELECT page_id, substr(coalesce(list_sort(list_transform(l, lambda x: struct_pack(n := length(x), a := x)), 'DESC')[1].a, trim(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '&[#a-zA-Z0-9]+;', ' ', 'g'), '\\s+', ' ', 'g'))), 1, 6000) AS body FROM a""")
def src4_article_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", readers.article_text(F.col("html")).alias("body"))


@query("""WITH u AS (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS l FROM pages)), f AS (SELECT page_id, replace(url, '&amp;', '&') AS url, min(pos) AS pos FROM u WHERE NOT regexp_matches(url, '#|/the') GROUP BY 1, 2)
  SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS place FROM f QUALIFY place < 25""")
def src5_article_links(t: Tables) -> DataFrame:
    return readers.article_links(t.pages, "page_id", "html", '(?i)href="([^"]+)"', "#|/the")


@query()
def src6_image_table(t: Tables) -> DataFrame:
    html = F.regexp_replace("html", '<a href="/([^"]*)">([^<]*)</a>', '<img src="/$1.jpg" alt="$2">')
    return readers.image_table(t.pages.select("page_id", html.alias("html")), "page_id", "html")


@query("""SELECT p_partkey, p_size FROM part WHERE NOT (p_partkey % 6 = 5 AND p_size > 30) AND p_partkey % 6 <> 4""")
def src7_listing(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 6 == 4, F.concat(F.lit("lib/._"), "p_partkey")).when(F.col("p_partkey") % 6 == 5, F.concat(F.lit("lib/"), "p_partkey", F.lit(".MP4"))).otherwise(F.concat(F.lit("lib/"), "p_partkey", F.lit(".jpg")))
    return readers.listing(t.part.withColumn("path", name), "path", "p_size", 30).select("p_partkey", "p_size")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""")
def snk1_write_day(t: Tables) -> DataFrame:
    path = folder(t, "board")
    days = t.events.select("event_id", F.to_date("ts").alias("day"))
    readers.write_day(days.filter("event_id % 2 = 0"), path)
    readers.write_day(days.repartition("day"), path)
    return t.spark.read.schema("event_id long, day date").json(path).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk2_append(t: Tables) -> DataFrame:
    path = folder(t, "ledger")
    for k in (0, 1):
        readers.append(t.events.filter(F.col("event_id") % 2 == k).select("event_type"), path)
    return t.spark.read.schema("event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def f1_clean_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", clean_text(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("title"))


@query("SELECT url_host, count(*) AS n FROM (SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS url_host FROM pages) GROUP BY 1")
def w15_article_hosts(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.regexp_extract("url", "https?://([^/]+)", 1).alias("url_host")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT page_id, page_id // 10 AS story, html, row_number() OVER (PARTITION BY page_id // 10 ORDER BY CASE WHEN regexp_matches(url, '://blog\\.') THEN 0 ELSE 1 END, page_id) AS turn FROM pages QUALIFY turn <= 5),
  u AS (SELECT story, page_id, turn, replace(unnest(l), '&amp;', '&') AS url, generate_subscripts(l, 1) AS pos FROM (SELECT *, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS l FROM c)),
  f AS (SELECT * FROM u WHERE NOT regexp_matches(url, '#|/the') QUALIFY row_number() OVER (PARTITION BY story, url ORDER BY turn, pos) = 1),
  b AS (SELECT *, regexp_matches(url, 'on|er') AS flagged, count(*) OVER (PARTITION BY story ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
  SELECT story, row_number() OVER (PARTITION BY story ORDER BY flagged, turn, pos) AS rank, page_id, url, flagged FROM b WHERE before < 12 QUALIFY rank <= 6""")
def w15_story_pictures(t: Tables) -> DataFrame:
    pages = t.pages.withColumn("story", F.floor(F.col("page_id") / 10))
    links = readers.article_links(pages, "page_id", "html", '(?i)href="([^"]+)"', "#|/the")
    return library.story_pictures(pages, links, "story", "page_id", F.col("url").rlike("://blog\\."), F.col("url").rlike("on|er"), 6)


@query("SELECT event_id, user_id FROM events WHERE user_id % 10 = 3")
def st3_inbox(t: Tables) -> DataFrame:
    return streams.drain(streams.inbox(events(t), 3).select("event_id", "user_id"), folder(t, "inbox"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2""")
def st2_daily_counts(t: Tables) -> DataFrame:
    out = streams.drain(streams.daily_counts(events(t), "ts"), folder(t, "days"), "complete")
    return out.withColumn("day", F.to_date("day"))


@query("SELECT (SELECT count(*) FROM events) * 6 AS n")
def st1_freshness_windows(t: Tables) -> DataFrame:
    return streams.drain(streams.freshness(events(t), "ts"), folder(t, "fresh"), "complete").agg(F.sum("n").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def st1_distinct_items(t: Tables) -> DataFrame:
    return streams.drain(streams.distinct_items(events(t), ["user_id", "event_type"], "ts").select("user_id", "event_type"), folder(t, "distinct")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS done FROM events WHERE event_type = 'purchase' GROUP BY 1")
def st6_done_counter(t: Tables) -> DataFrame:
    return streams.drain(streams.done_counter(events(t)), folder(t, "done"), "complete")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def st10_queue(t: Tables) -> DataFrame:
    return streams.drain(streams.latest_per_id(events(t), "user_id", "event_id", ["event_type"]), folder(t, "queue"), "complete")


@query("SELECT user_id, event_type AS stage, epoch_us(CASE WHEN event_type = 'purchase' THEN max(ts) ELSE min(ts) END) AS micros FROM events GROUP BY 1, 2")
def st5_stage_clock(t: Tables) -> DataFrame:
    changes = streams.drain(streams.stage_clock(events(t)), folder(t, "clock"), "update")
    best = F.when(F.col("stage") == "purchase", F.max("micros")).otherwise(F.min("micros"))
    return changes.groupBy("user_id", "stage").agg(best.alias("micros"))


@query()
def st7_overdue(t: Tables) -> DataFrame:
    return streams.drain(streams.overdue(events(t)), folder(t, "overdue"))


def scans(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Four scans of a library with a root a brand, as files that came one after the other:
    the first has more than the others, and some roots change each time."""
    path = folder(t, "scans")
    rows = t.part.select(F.col("p_brand").alias("root"), F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    for k in range(4):
        own = rows.filter("path % 5 <> 0") if k else rows
        own = own.withColumn("size", F.when(F.col("root").endswith("5"), F.col("size") + k).otherwise(F.col("size"))).withColumn("scan", F.lit(k).cast("long"))
        total = own.groupBy("root").agg(F.count("*").alias("total"))
        own.join(total, "root").select("root", "scan", "path", "size", "total").write.mode("append").parquet(path)
    return t.spark.read.parquet(path), t.spark.readStream.schema("root string, scan long, path long, size long, total long").option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT p_partkey AS path, p_size AS size FROM part WHERE p_partkey % 5 <> 0 AND p_brand NOT LIKE '%5'")
def st8_stable_listing(t: Tables) -> DataFrame:
    listing, stream = scans(t)
    return gates.stable_listing(listing, gates.trusted_scans(stream, folder(t, "stable"))).select("path", "size")


@query("""WITH k AS (SELECT unnest(range(4)) AS scan), r AS (SELECT p_brand AS root, scan, p_partkey AS path, p_size + CASE WHEN p_brand LIKE '%5' THEN scan ELSE 0 END AS size FROM part, k WHERE scan = 0 OR p_partkey % 5 <> 0),
  h AS (SELECT root, scan, md5(string_agg(path || ':' || size, ',' ORDER BY path)) AS h FROM r GROUP BY 1, 2) SELECT a.root, CAST(a.scan AS BIGINT) AS scan FROM h a JOIN h b ON a.root = b.root AND a.scan = b.scan + 1 AND a.h = b.h""")
def st8_trusted_scans(t: Tables) -> DataFrame:
    return gates.trusted_scans(scans(t)[1], folder(t, "trusted"))


_GATE = """p AS (SELECT row_number() OVER (ORDER BY page_id) AS n, page_id, url AS path, strlen(html) // 16 AS size, md5(html) AS md5 FROM pages),
  r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS page_id, false AS kept, CAST([] AS VARCHAR[]) AS paths, CAST([] AS BIGINT[]) AS sizes, CAST([] AS VARCHAR[]) AS sums
    UNION ALL SELECT n, page_id, ok, CASE WHEN ok THEN list_append(paths, path) ELSE paths END, CASE WHEN ok THEN list_append(sizes, size) ELSE sizes END, CASE WHEN ok THEN list_append(sums, md5) ELSE sums END FROM (SELECT p.*, paths, sizes, sums, NOT (list_contains(paths, p.path) OR list_contains(sizes, p.size) OR list_contains(sums, p.md5)) AS ok FROM r JOIN p ON p.n = r.n + 1))"""


@query(f"WITH RECURSIVE {_GATE} SELECT page_id FROM r WHERE kept")
def st9_file_gate(t: Tables) -> DataFrame:
    """Path, then size (in steps of 16 bytes), then checksum, over a stream that delivers
    every file twice."""
    path = folder(t, "files")
    rows = t.pages.select("page_id", F.col("url").alias("path"), F.floor(F.octet_length("html") / 16).alias("size"), F.md5(F.col("html").cast("binary")).alias("md5"))
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return gates.file_gate(stream, folder(t, "gate"), ["path", "size", "md5"], "page_id").select("page_id")


@query(f"WITH RECURSIVE {_GATE} SELECT page_id FROM r WHERE kept")
def st9_content_gate_cascade(t: Tables) -> DataFrame:
    """The same as a batch."""
    rows = t.pages.select("page_id", F.col("url").alias("path"), F.floor(F.octet_length("html") / 16).alias("size"), F.md5(F.col("html").cast("binary")).alias("md5"))
    return gates.content_gate(rows, rows.limit(0), ["path", "size", "md5"], "page_id").select("page_id")


@query("""WITH i AS (SELECT user_id, event_type, max(CASE WHEN event_id % 50 = 7 OR event_type = 'error' AND user_id % 3 = 0 THEN NULL ELSE ts END) AS ts FROM events GROUP BY 1, 2), a AS (SELECT user_id, event_type, coalesce((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 3.6e9, 999.0) AS age FROM i)
  SELECT user_id, event_type, round(age, 4) AS age, CASE WHEN age <= 6 THEN 6 WHEN age <= 12 THEN 12 WHEN age <= 24 THEN 24 WHEN age <= 36 THEN 36 WHEN age <= 72 THEN 72 ELSE 999 END AS band, CASE WHEN age <= 6 THEN 25 WHEN age <= 12 THEN 15 WHEN age <= 24 THEN 8 ELSE 0 END AS points, CAST(CASE WHEN age > 72 THEN 0.45 WHEN age > 36 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS factor FROM a""")
def st1_board_items(t: Tables) -> DataFrame:
    """Items are users' kinds of events; some have no stamp."""
    stamp = F.when((F.col("event_id") % 50 == 7) | ((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)), None).otherwise(F.col("ts"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = gates.board_items(events(t).withColumn("ts", stamp), t.events.withColumn("ts", stamp.cast("timestamp")), folder(t, "items"), ["user_id", "event_type"], "ts", now)
    return rows.drop("late").withColumn("age", F.round("age", 4))


@query("SELECT event_id FROM events")
def st4_read_since_cursor(t: Tables) -> DataFrame:
    rows = events(t).select("event_id")
    path = folder(t, "cursor")
    streams.drain(rows, path)
    return streams.drain(rows, path)  # nothing new since: the checkpoint is the cursor


@query("SELECT event_id, k AS look FROM events, range(1, 4) t(k) WHERE event_id % 2 = 1")
def st4_peek(t: Tables) -> DataFrame:
    """Events with even ids have been read when the others arrive; two looks and a read
    bring the same."""
    source, cursor = folder(t, "arrivals"), folder(t, "cursor")
    rows = t.events.select("event_id")
    rows.filter("event_id % 2 = 0").write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).parquet(source)
    before = streams.drain(stream, cursor)
    seen = before.count()
    rows.filter("event_id % 2 = 1").write.mode("append").parquet(source)
    looks = [streams.peek(stream, cursor).withColumn("look", F.lit(k).cast("long")) for k in (1, 2)]
    after = streams.drain(stream, cursor)
    new = after.filter("event_id % 2 = 1").withColumn("look", F.lit(3).cast("long")) if after.count() > seen else looks[0].limit(0)
    return looks[0].unionByName(looks[1]).unionByName(new)


@query("SELECT event_id FROM events")
def st4_read_all_since_cursor(t: Tables) -> DataFrame:
    return st4_read_since_cursor(t)


@query("""WITH w AS (SELECT conv_id, turn, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n FROM conversations) SELECT conv_id, CAST(sum(n) AS BIGINT) AS words FROM w GROUP BY 1""")
def w3_script_words(t: Tables) -> DataFrame:
    rows = timeline.sentence_times(t.conversations, "conv_id", "turn", "text", F.lit(60.0))
    return rows.groupBy("conv_id").agg(F.sum("words").cast("long").alias("words"))
