"""Checks, choices and harvests over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks
from ..sources import readers
from .library_queries import _MATCH
from .registry import Tables, query


@query("""WITH f AS (SELECT user_id, event_id, r, (event_id * (r + 3)) % 70 AS red, (event_id * 7 + r) % 60 AS green, CAST(floor(value) AS BIGINT) % 80 AS blue FROM events, range(3) t(r)), s AS (SELECT *, first_value(red) OVER w AS r0, first_value(green) OVER w AS g0, first_value(blue) OVER w AS b0 FROM f WINDOW w AS (PARTITION BY user_id, r ORDER BY event_id))
  SELECT user_id, CAST(r AS INTEGER) AS region, count(*) AS violations, min(event_id) AS first FROM s WHERE greatest(abs(red - r0), abs(green - g0), abs(blue - b0)) > 46 GROUP BY 1, 2""")
def w6_frame_violations(t: Tables) -> DataFrame:
    r, e = F.col("region"), F.col("event_id")
    rows = t.events.withColumn("region", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    frames = rows.select("user_id", "event_id", "region", (e * (r + 3) % 70).alias("red"), ((e * 7 + r) % 60).alias("green"), (F.floor("value") % 80).alias("blue"))
    return checks.frame_violations(frames, "user_id", "event_id", "region", ["red", "green", "blue"])


@query("""WITH h AS (SELECT event_id AS seq, user_id % 40 AS item, user_id * 3 % 200 AS job FROM events WHERE event_type = 'purchase'), i AS (SELECT DISTINCT p_size % 7 AS grp, p_partkey % 60 AS item FROM part UNION SELECT DISTINCT 7, p_partkey % 40 FROM part), j AS (SELECT DISTINCT c_custkey AS job, c_custkey % 9 AS grp FROM customer),
  l AS (SELECT item, max(seq) AS last FROM h GROUP BY 1), r AS (SELECT grp, item, coalesce(last, -1) AS last FROM i LEFT JOIN l USING (item)), n AS (SELECT grp, list(item ORDER BY item) FILTER (last < 0) AS fresh, list(item ORDER BY last, item) AS every FROM r GROUP BY 1),
  k AS (SELECT j.job, max_by(h.item, seq) AS kept FROM j JOIN h ON h.job = j.job JOIN i ON i.grp = j.grp AND i.item = h.item GROUP BY 1)
  SELECT j.job, CASE WHEN kept IS NOT NULL THEN kept WHEN fresh IS NOT NULL THEN fresh[j.job * 7 % len(fresh) + 1] WHEN every IS NOT NULL THEN every[j.job * 7 % greatest(1, len(every) // 2) + 1] END AS item, CASE WHEN kept IS NOT NULL THEN 'kept' WHEN fresh IS NOT NULL THEN 'new' WHEN every IS NOT NULL THEN 'oldest' END AS why FROM j LEFT JOIN k ON k.job = j.job LEFT JOIN n ON n.grp = j.grp""")
def w7_least_repeated(t: Tables) -> DataFrame:
    history = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("item"), (F.col("user_id") * 3 % 200).alias("job"))
    items = t.part.select((F.col("p_size") % 7).cast("long").alias("grp"), (F.col("p_partkey") % 60).alias("item")).distinct().unionByName(t.part.select(F.lit(7).cast("long").alias("grp"), (F.col("p_partkey") % 40).alias("item")).distinct())
    jobs = t.customer.select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 9).alias("grp"))
    return checks.least_repeated(jobs, items, history, "job", "grp", "item", "seq", F.col("job") * 7)


_MEASURES = {"clear_face": (3, 0.2, 0.6), "has_face": (5, 0.3, 0.9), "legible_small": (7, 0.1, 0.5), "text_stands_out": (11, 0.4, 0.8), "well_placed": (13, 0.25, 0.75), "balance": (17, 0.0, 0.3), "clean_overlay": (19, 0.5, 1.0)}


def _member_sql(k: int, low: float, high: float) -> str:
    x = f"(p_partkey * {k} % 101) / 100.0"
    return f"CASE WHEN {x} BETWEEN {low} AND {high} THEN 1.0 ELSE greatest(0.0, 1.0 - CASE WHEN {x} < {low} THEN {low} - {x} ELSE {x} - {high} END / {high - low}) END"


@query("SELECT p_partkey, round(" + " + ".join(f"CAST({_member_sql(*v)} AS DOUBLE) * {checks.COVER_WEIGHTS[k]}" for k, v in _MEASURES.items()) + ", 6) AS score FROM part WHERE p_partkey % 8 <> 7 UNION ALL SELECT p_partkey, round(" + " + ".join(f"CAST({_member_sql(*v)} AS DOUBLE) * {checks.COVER_WEIGHTS[k]}" for k, v in _MEASURES.items() if k != "has_face") + ", 6) FROM part WHERE p_partkey % 8 = 7")
def x31_seven_measures(t: Tables) -> DataFrame:
    """Every eighth cover has no measure of its faces."""
    p = F.col("p_partkey")
    measured = {k: checks.membership((p * n % 101) / 100.0, low, high) for k, (n, low, high) in _MEASURES.items()}
    measured["has_face"] = F.when(p % 8 != 7, measured["has_face"])
    return t.part.select("p_partkey", checks.cover_score(measured, digits=6).alias("score"))


@query("""SELECT event_id, CASE WHEN s IS NULL OR s < 0.3 THEN 'broken' WHEN s < 4.5 THEN 'short' WHEN d IS NULL THEN 'no frame' WHEN d < 8 THEN 'flat' WHEN f < 1.2 THEN 'frozen' WHEN b IS NULL OR b < 60 THEN 'blurred' ELSE 'ok' END AS verdict FROM (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_id % 97 / 10.0 END AS s, CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_id % 53 END AS d, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 31 / 10.0 END AS f, CASE WHEN event_id % 43 = 0 THEN NULL ELSE event_id % 211 END AS b FROM events)""")
def x32_clip_verdict(t: Tables) -> DataFrame:
    e = F.col("event_id")
    some = lambda n, c: F.when(e % n != 0, c)
    return t.events.select("event_id", checks.clip_verdict(some(41, e % 97 / 10.0), some(37, e % 53), some(3, e % 31 / 10.0), some(43, e % 211)).alias("verdict"))


#: Names as they stand in texts, some of them inside others, and codes.
_COUNTRIES = {"guinea": "gn", "equatorial guinea": "gq", "new guinea": "pg", "niger": "ne", "nigeria": "ng", "chad": "td", "mali": "ml", "malia": "xx", "united states": "us", "usa": "us", "america": "us", "oman": "om"}
_TEXT = "CASE event_id % 11 WHEN 0 THEN 'From Equatorial Guinea to Guinea' WHEN 1 THEN 'New Guinea, Niger.' WHEN 2 THEN 'nigeria/mali' WHEN 3 THEN 'The USA of America: United States!' WHEN 4 THEN 'romania and Malian' WHEN 5 THEN 'Mali Oman Chad Niger' WHEN 6 THEN NULL WHEN 7 THEN 'oman' WHEN 8 THEN 'chad chad (Chad)' WHEN 9 THEN 'Guinea_x Nigerém' ELSE event_type END"


def _countries_sql() -> str:
    usable = [(n, c) for n, c in sorted(_COUNTRIES.items(), key=lambda x: -len(x[0])) if n != "chad" and (len(n) >= 4 or " " in n)]
    sql = f"t0 AS (SELECT event_id, lower(coalesce({_TEXT}, '')) AS t, CAST([] AS VARCHAR[]) AS c FROM events)"
    for k, (n, c) in enumerate(usable):
        hit = f"len(c) < 2 AND regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){n}($|[^\\p{{L}}\\p{{N}}_])')"
        sql += f", t{k + 1} AS (SELECT event_id, CASE WHEN {hit} THEN replace(t, '{n}', ' ') ELSE t END AS t, CASE WHEN {hit} AND NOT list_contains(c, '{c}') THEN list_append(c, '{c}') ELSE c END AS c FROM t{k})"
    return f"WITH {sql} SELECT event_id, array_to_string(c, ',') AS codes FROM t{len(usable)}"


@query(_countries_sql())
def x26_countries(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.array_join(checks.countries(F.expr(_TEXT), _COUNTRIES, ["chad"]), ",").alias("codes"))


_CONTRAST, _FIGURES = ["tion", "en", "de la"], ["ent que", "sch", "ion de"]
_F = f"' ' || {_MATCH.format(c='text')} || ' '"


@query(f"""WITH f AS MATERIALIZED (SELECT conv_id, turn, {_F} AS f FROM conversations), tm(team, alias) AS (VALUES ('fr', 'le'), ('fr', 'la'), ('de', 'der'), ('en', 'the'), ('es', 'los que')),
  pp AS (SELECT DISTINCT conv_id, string_split({_MATCH.format(c='text')}, ' ')[2] AS name FROM conversations), c AS (SELECT conv_id, turn, (SELECT count(DISTINCT team) FROM tm WHERE contains(f, ' ' || alias || ' ')) >= 2 AS teams, (SELECT count(*) FROM pp WHERE pp.conv_id = f.conv_id AND name <> '' AND contains(f, ' ' || name || ' ')) >= 2 AS people,
  {' OR '.join(f"contains(f, ' {p} ')" for p in _CONTRAST)} AS contrast, {' OR '.join(f"contains(f, '{p}')" for p in _FIGURES)} AS statistics FROM f)
  SELECT * FROM c WHERE teams OR people OR contrast OR statistics""")
def q6_cues(t: Tables) -> DataFrame:
    from ..functions import text as tx

    teams = t.spark.createDataFrame([("fr", "Le"), ("fr", "la"), ("de", "der"), ("en", "the"), ("es", "los  que")], "team string, alias string")
    people = t.conversations.select("conv_id", F.get(F.split(tx.fold_match(F.col("text")), " "), F.lit(1)).alias("name")).filter("name <> ''").distinct()
    return checks.two_subject_cues(t.conversations, ["conv_id", "turn"], "text", teams, people, "conv_id", _CONTRAST, _FIGURES)


@query("""WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'p' || event_id % 50 END AS top, CASE WHEN event_id % 14 = 3 THEN NULL ELSE 'p' || event_id * 3 % 50 END AS bottom, CASE WHEN event_id % 5 = 1 THEN 'x' END AS second, event_id % 2 = 0 AS m FROM events), z AS (SELECT DISTINCT 'p' || p_partkey AS asset, p_size >= 20 AS wide FROM part)
  SELECT event_id, d AS decision, CASE WHEN d = 'paired' THEN bottom ELSE second END AS second FROM (SELECT *, CASE WHEN top = '' THEN 'waiting' WHEN second = 'x' AND NOT m THEN 'human' WHEN NOT coalesce(a.wide, true) THEN 'tall top' WHEN bottom IS NULL THEN 'missing' WHEN NOT coalesce(b.wide, true) THEN 'tall bottom' WHEN top = bottom THEN 'same' ELSE 'paired' END AS d FROM s LEFT JOIN z a ON a.asset = top LEFT JOIN z b ON b.asset = bottom)""")
def q8_split_decisions(t: Tables) -> DataFrame:
    e = F.col("event_id")
    name = lambda c: F.concat(F.lit("p"), (c % 50).cast("string"))
    slots = t.events.select("user_id", e.alias("slot"), F.when(e % 9 == 0, "").otherwise(name(e)).alias("top"), F.when(e % 14 != 3, name(e * 3)).alias("bottom"), F.when(e % 5 == 1, "x").alias("second"), (e % 2 == 0).alias("by_machine"))
    sizes = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("asset"), F.col("p_size").alias("w"), F.lit(20).alias("h"))
    return checks.split_frames(slots, sizes, "user_id").select(F.col("slot").alias("event_id"), "decision", "second")


@query("""WITH a AS (SELECT conv_id, turn, conv_id * 10 + turn AS doc_id FROM conversations WHERE role = 'assistant'), l AS (SELECT doc_id, source AS subject, list_slice(string_split(text, ' '), 1, 6) AS labels FROM documents WHERE lang = 'en' AND text IS NOT NULL), c AS (SELECT item_id * 3 AS doc_id, min(text) AS caption FROM benchmark GROUP BY 1)
  SELECT conv_id, turn, coalesce(subject, '') AS subject, array_to_string(CASE WHEN len(coalesce(labels, [])) > 0 THEN labels WHEN coalesce(caption, '') <> '' THEN [caption] ELSE [] END, '|') AS labels FROM a LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) WHERE coalesce(subject, '') <> '' OR len(coalesce(labels, [])) > 0 OR coalesce(caption, '') <> ''""")
def a23_harvest(t: Tables) -> DataFrame:
    approved = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", (F.col("conv_id") * 10 + F.col("turn")).alias("asset"))
    lib = t.documents.filter("lang = 'en' AND text IS NOT NULL").select(F.col("doc_id").alias("asset"), F.col("source").alias("subject"), F.split("text", " ").alias("labels"))
    captions = t.benchmark.select((F.col("item_id") * 3).alias("asset"), F.col("text").alias("caption"))
    return checks.harvest_pairs(approved, lib, captions, "asset").select("conv_id", "turn", "subject", F.array_join("labels", "|").alias("labels"))


@query("SELECT doc_id FROM documents ORDER BY source, n_chars DESC, doc_id LIMIT 60 OFFSET 120")
def w3_review_page(t: Tables) -> DataFrame:
    """The third page."""
    return checks.page(t.documents, ["source", F.desc("n_chars"), "doc_id"], 2).select("doc_id")


@query("""WITH s AS (SELECT conv_id, turn, length(text) / 40.0 AS length, turn % 4 = 2 AS clip FROM conversations) SELECT conv_id, turn, round(length, 6) AS length FROM s WHERE NOT clip AND length < 2.35 AND conv_id IN (SELECT conv_id FROM s WHERE clip)""")
def w4_short_by_clips(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", (F.length("text") / 40.0).alias("length"), (F.col("turn") % 4 == 2).alias("clip"))
    return checks.short_by_clips(rows, "conv_id", "length", "clip").select("conv_id", "turn", F.round("length", 6).alias("length"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '<a href="/([^"]*)"', '<img data-src="https://i.example/\1.jpg?a=1&amp;b=2" src=https://i.example/\1.webp', 'g'), '</title>', '</title><meta property="og:image" content="https://i.example/share' || page_id || '.jpg"><meta property=''og:image'' content="https://i.example/cover' || page_id || '"/>') AS html FROM pages),
  a AS (SELECT page_id, html, CASE WHEN regexp_matches(html, '(?is)<article[^>]*>.*?</article>') THEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) ELSE html END AS area FROM h),
  l AS (SELECT page_id, list_concat(regexp_extract_all(area, '(?:data-src|data-original|src)=["'']?(https?://[^"''\s>]+\.(?:jpg|jpeg|png|webp)[^"''\s>]*)', 1), regexp_extract_all(html, '<meta[^>]+property=["'']og:image["''][^>]+content=["'']([^"'']+)', 1)) AS l FROM a),
  u AS (SELECT page_id, replace(unnest(l), '&amp;', '&') AS url, generate_subscripts(l, 1) AS pos FROM l), f AS (SELECT page_id, url, min(pos) AS pos FROM u WHERE NOT regexp_matches(url, '(?i)(logo|icon|avatar|sprite|banner|ads?|quangcao|placeholder|blank|1x1|spacer|favicon|thumb_w/(4|6|8)\d|/\d{2}x\d{2}/|author|tacgia|share|social)') GROUP BY 1, 2)
  SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS place FROM f QUALIFY place < 25""")
def src5_article_image_urls(t: Tables) -> DataFrame:
    """Links become pictures, and every page has two pictures to share."""
    html = F.regexp_replace("html", '<a href="/([^"]*)"', '<img data-src="https://i.example/$1.jpg?a=1&amp;b=2" src=https://i.example/$1.webp')
    meta = F.concat(F.lit('</title><meta property="og:image" content="https://i.example/share'), "page_id", F.lit(".jpg\"><meta property='og:image' content=\"https://i.example/cover"), "page_id", F.lit('"/>'))
    parts = F.split(html, "</title>", 2)
    pages = t.pages.select("page_id", F.when(F.size(parts) == 2, F.concat(parts[0], meta, parts[1])).otherwise(html).alias("html"))
    return readers.article_image_urls(pages, "page_id", "html")
