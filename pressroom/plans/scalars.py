"""Scalar rules (X1 to X37) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import Tables, query

#: SQL for the first words of a document.
HEAD = "array_to_string(list_slice(string_split(text, ' '), 1, {n}), ' ')"
BARE = "replace(strip_accents(lower({c})), 'đ', 'd')"


def head(n: int, column: str = "text"):
    return F.array_join(F.slice(F.split(column, " "), 1, n), " ")


@query(f"""SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]', ' ', 'g') AS radar,
  {BARE.format(c='text')} AS keep,
  trim(regexp_replace({BARE.format(c='text')}, '[^a-z0-9 ]', ' ', 'g')) AS name,
  trim(regexp_replace({BARE.format(c='text')}, '[^a-z0-9]+', ' ', 'g')) AS match,
  regexp_replace(substr(regexp_replace({BARE.format(c='text')}, '[^a-z0-9]+', '-', 'g'), 1, 42), '^-+|-+$', '', 'g') AS slug
  FROM documents""")
def x1_folds(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", tx.fold_radar(c).alias("radar"), tx.fold_keep(c).alias("keep"), tx.fold_name(c).alias("name"), tx.fold_match(c).alias("match"), tx.slug(c).alias("slug"))


@query("""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM conversations),
  m AS (SELECT conv_id, turn, string_split(regexp_replace(one, '([.!?…]["”'']?) ', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM s)
  SELECT conv_id, turn, len(parts) AS n_sentences, parts[1] AS first_sentence, parts[len(parts)] AS last_sentence FROM m""")
def x2_sentences(t: Tables) -> DataFrame:
    s = t.conversations.select("conv_id", "turn", tx.sentences(F.col("text")).alias("parts"))
    return s.select("conv_id", "turn", F.size("parts").alias("n_sentences"), F.element_at("parts", 1).alias("first_sentence"), F.element_at("parts", -1).alias("last_sentence"))


@query("""WITH w AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words FROM conversations)
  SELECT conv_id, turn, words, round(words * 60.0 / 258, 6) AS seconds, CAST(floor(words * 60.0 / 226 * 258 / 60.0) AS INTEGER) AS budget FROM w""")
def x3_speech_time(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", tx.word_count(F.col("text")).alias("words"))
    return w.select("conv_id", "turn", "words", F.round(tx.speech_seconds(F.col("words")), 6).alias("seconds"), tx.word_budget(tx.speech_seconds(F.col("words"), 226)).alias("budget"))


@query("""SELECT event_id, round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(date_trunc('second', ts))) / 3.6e9, 6) AS age,
  event_id % 5 = 4 AS broken FROM events WHERE event_id % 5 <> 4
  UNION ALL SELECT event_id, 999.0, true FROM events WHERE event_id % 5 = 4""")
def x4_feed_age(t: Tables) -> DataFrame:
    ts = F.date_trunc("second", "ts")
    forms = [F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.concat(F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("some day")]
    stamp = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    age = tx.age_hours(tx.feed_time(stamp), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return t.events.select("event_id", F.round(age, 6).alias("age"), (F.col("event_id") % 5 == 4).alias("broken"))


@query(f"SELECT doc_id, substr(md5(regexp_replace(strip_accents(lower({HEAD.format(n=8)})), '[^a-z0-9 ]', ' ', 'g')), 1, 6) AS ma FROM documents")
def x5_short_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.short_id(head(8)).alias("ma"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' 2024' ELSE CASE WHEN p_partkey % 3 = 1 THEN p_name || ' 2018' ELSE p_name END END AS latest,
  CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 0 ELSE 0 END AS n_queries,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || ' 2008' END AS first_query FROM part""")
def x8_x9_years(t: Tables) -> DataFrame:
    q = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" 2008, 2024"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" 2018"))).otherwise(F.col("p_name"))
    made = tx.queries_per_year(q, F.col("p_name"), F.array().cast("array<string>"))
    return t.part.select("p_partkey", tx.one_year(q).alias("latest"), F.size(made).alias("n_queries"), F.try_element_at(made, F.lit(1)).alias("first_query"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)ring|gear') THEN p_name || ' highlights' ELSE '' END AS video,
  CASE WHEN regexp_matches(p_name, '(?i)widget|small') THEN p_name ELSE p_name || ' machine' END AS anchored,
  CASE WHEN regexp_matches(p_name, '(?i)ring') AND NOT regexp_matches(p_name, '20[0-9][0-9]') THEN p_name || ' 2026' ELSE p_name END AS timed,
  CASE WHEN p_size < 24 THEN replace(p_brand, 'Brand', 'Make') ELSE p_brand END AS renamed FROM part""")
def x10_x13_query_rules(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", F.when(n.rlike("(?i)ring|gear"), F.concat(n, F.lit(" highlights"))).otherwise("").alias("video"), tx.anchored(n, "widget|small", "machine").alias("anchored"), F.when(n.rlike("(?i)ring") & ~n.rlike("20[0-9][0-9]"), F.concat(n, F.lit(" 2026"))).otherwise(n).alias("timed"), F.when(F.col("p_size") < 24, F.replace("p_brand", F.lit("Brand"), F.lit("Make"))).otherwise(F.col("p_brand")).alias("renamed"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def x14_lenient_json(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` and no more"))
    return t.events.select("event_id", tx.lenient_json(noisy, "k int")["k"].alias("k"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size * 40 END AS w, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(p_partkey % 1900 + 1 AS INTEGER) END AS h,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size * 40 >= p_partkey % 1900 + 1 END AS landscape FROM part""")
def x15_size_pair(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 4 == 3, F.lit("large")).otherwise(F.concat(F.col("p_size") * 40, F.lit("x"), F.col("p_partkey") % 1900 + 1))
    s = tx.size_pair(raw)
    return t.part.select("p_partkey", s["w"].alias("w"), s["h"].alias("h"), (s["w"] >= s["h"]).alias("landscape"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey || '.mp4' AS file, CAST(l_linenumber AS DOUBLE) AS start, CAST(l_linenumber + l_quantity AS DOUBLE) AS stop,
  CASE WHEN l_partkey % 2 = 0 THEN l_tax END AS frame_x, l_partkey || '.mp4#' || printf('%.1f', CAST(l_linenumber AS DOUBLE)) || '-' || printf('%.1f', l_linenumber + l_quantity) AS segment FROM lineitem""")
def x16_x17_clip_codes(t: Tables) -> DataFrame:
    frame = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("::"), "l_tax", F.lit(",0,0.5,0.5"))).otherwise(F.lit("::x,0,0,0"))
    code = F.concat(F.lit("clip::"), "l_partkey", F.lit(".mp4::"), "l_linenumber", F.lit("::"), F.col("l_linenumber") + F.col("l_quantity"), frame)
    c = tx.clip_code(code)
    segment = F.format_string("%s#%.1f-%.1f", c["file"], c["from"], c["to"])
    return t.lineitem.select("l_orderkey", "l_linenumber", c["file"].alias("file"), c["from"].alias("start"), c["to"].alias("stop"), c["frame"][0].alias("frame_x"), segment.alias("segment"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ' h ' || (s % 3600 // 60) || ' m' WHEN s >= 60 THEN (s // 60) || ' m ' || (s % 60) || ' s' ELSE s || ' s' END AS spoken
  FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events)""")
def x25_duration_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", tx.duration_text(F.col("value") * 100).alias("spoken"))


@query(f"SELECT doc_id, {BARE.format(c='text')} <> lower(text) AS marked FROM documents")
def x28_language_hint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.has_marks(F.col("text")).alias("marked"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<article>.*?</article>') AND regexp_extract(html, '(?s)<article>(.*?)</article>', 1) <> '' THEN regexp_extract(html, '(?s)<article>(.*?)</article>', 1) ELSE html END AS body FROM pages")
def x35_marked_section(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.marked_section(F.col("html"), "<article>", "</article>").alias("body"))


@query("SELECT CASE WHEN hour(ts) < 10 THEN 'morning' WHEN hour(ts) < 16 THEN 'noon' ELSE 'evening' END AS shift, count(*) AS n FROM events GROUP BY 1")
def x36_day_shift(t: Tables) -> DataFrame:
    return t.events.groupBy(tx.day_shift(F.hour("ts")).alias("shift")).agg(F.count("*").alias("n"))


@query("""SELECT vec_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), lambda h, b: h * 2 + b) AS bits FROM embeddings""")
def x30_difference_hash(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", tx.difference_bits(F.col("embedding")).alias("bits"))


@query("""WITH p AS (SELECT p_partkey, p_size * 40 AS w, p_partkey % 1900 + 100 AS h FROM part)
  SELECT p_partkey, CASE WHEN w / h >= 2.0 OR greatest(1080 / w, 1920 / h) > 2.3 THEN 'fit' WHEN w / h >= 1 THEN 'pan' ELSE 'zoom' END AS style FROM p""")
def x33_motion_style(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.motion_style(F.col("p_size") * 40, F.col("p_partkey") % 1900 + 100).alias("style"))


@query("""WITH m AS (SELECT event_id, greatest(0.0, least(1.0, (value - 5) / 15.0, (120 - value) / 60.0)) AS a, greatest(0.0, least(1.0, (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1) / 11.0, (110 - CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 40.0)) AS b FROM events)
  SELECT event_id, round(60 * a + 40 * b, 6) AS score, CASE WHEN a < 0.1 THEN 'short' WHEN b < 0.1 THEN 'flat' WHEN a < 0.5 THEN 'frozen' ELSE 'good' END AS verdict FROM m""")
def x31_x32_weighted_score(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    m = t.events.select("event_id", tx.trapezoid(F.col("value"), 5, 20, 60, 120).alias("a"), tx.trapezoid(k, -1, 10, 70, 110).alias("b"))
    return m.select("event_id", F.round(60 * F.col("a") + 40 * F.col("b"), 6).alias("score"), F.when(F.col("a") < 0.1, "short").when(F.col("b") < 0.1, "flat").when(F.col("a") < 0.5, "frozen").otherwise("good").alias("verdict"))


@query("""SELECT event_id, greatest(10.0, least(60.0, round(value, 1))) AS speed, coalesce(TRY_CAST(nullif(event_type, 'click') AS INTEGER), 7) AS style,
  CASE WHEN event_type = 'error' THEN 'default' ELSE event_type END AS voice FROM events""")
def x21_clamped_settings(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.greatest(F.lit(10.0), F.least(F.lit(60.0), F.round("value", 1))).alias("speed"), F.coalesce(F.col("event_type").try_cast("int"), F.lit(7)).alias("style"), F.when(F.col("event_type") == "error", "default").otherwise(F.col("event_type")).alias("voice"))


@query(f"""WITH d AS (SELECT doc_id, n_chars, {HEAD.format(n=8)} AS title, text FROM documents),
  g AS (SELECT doc_id, list_filter([CASE WHEN NOT regexp_matches(title, '(?i)(^|[ \\n])(the|le|der|el)[ \\n,.]') THEN 'topic' END, CASE WHEN length(title) > 60 THEN 'title' END, CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL) AS r FROM d)
  SELECT doc_id, array_to_string(r, ',') AS reasons, len(r) = 0 AS passed FROM g""")
def x20_script_gates(t: Tables) -> DataFrame:
    title = head(8)
    reasons = F.array_compact(F.array(F.when(~title.rlike("(?i)(^|[ \\n])(the|le|der|el)[ \\n,.]"), "topic"), F.when(F.length(title) > 60, "title"), F.when(F.col("n_chars") < 300, "short"), F.when(F.col("text").rlike("[0-9]"), "digits")))
    return t.documents.select("doc_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'img/' || conv_id || '.jpg' WHEN turn % 3 = 1 THEN 'clip::a.mp4::1::2::0,0,0.5,' || (turn % 2) ELSE 'clip::a.mp4::1' END AS v FROM conversations)
  SELECT conv_id, turn, CASE WHEN v LIKE 'img/%' THEN true WHEN len(string_split(v, '::')) IN (4, 5) THEN true ELSE false END AS valid FROM s""")
def x37_slot_values(t: Tables) -> DataFrame:
    v = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("img/"), "conv_id", F.lit(".jpg"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("clip::a.mp4::1::2::0,0,0.5,"), F.col("turn") % 2)).otherwise("clip::a.mp4::1")
    c = tx.clip_code(v)
    inside = c.isNotNull() & (F.size(F.split(v, "::")).isin(4, 5)) & (c["frame"].isNull() & (F.size(F.split(v, "::")) == 4) | F.forall(c["frame"], lambda x: x.between(0, 1)))
    return t.conversations.select("conv_id", "turn", F.coalesce(v.rlike("^img/.*\\.jpg$") | inside, F.lit(False)).alias("valid"))


@query("""SELECT doc_id, cum.n AS n_tags, cum.used AS used FROM (SELECT doc_id, (SELECT struct_pack(n := count(*), used := coalesce(sum(length(tag) + 2), 0)) FROM (
    SELECT tag, pos, sum(length(tag) + 2) OVER (ORDER BY pos) AS run FROM (SELECT min_by(tag, pos) AS tag, min(pos) AS pos FROM (SELECT unnest(l) AS tag, generate_subscripts(l, 1) AS pos) GROUP BY lower(tag))) WHERE run <= 490) AS cum
  FROM (SELECT doc_id, flatten(list_transform(list_filter(list_transform(string_split_regex(replace(text, ',', ';'), '[/|;]'), lambda x: regexp_replace(x, '^[ .,;:\\-]+|[ .,;:\\-]+$', '', 'g')), lambda x: length(x) > 0 AND length(x) <= 60), lambda x: [x, replace(strip_accents(lower(x)), 'đ', 'd')])) AS l FROM documents))""")
def x6_tags(t: Tables) -> DataFrame:
    tags = tx.tag_list(F.replace(F.col("text"), F.lit(","), F.lit(";")))
    rows = t.documents.select("doc_id", tags.alias("tags"))
    return rows.select("doc_id", F.size("tags").cast("long").alias("n_tags"), F.aggregate("tags", F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 2).alias("used"))


@query(r"""WITH l AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS l FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM l), b AS (SELECT *, regexp_replace(w, '[^\p{L}\p{N}]+$', '') AS bare FROM w WHERE p > 1),
  f AS (SELECT *, regexp_matches(bare, '^\p{Lu}') AND lower(bare) NOT IN ('the', 'le', 'der', 'el') AS proper FROM b), g AS (SELECT *, coalesce(sum(CASE WHEN NOT proper OR bare <> w THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM f), r AS (SELECT doc_id, string_agg(bare, ' ' ORDER BY p) AS run FROM g WHERE proper GROUP BY doc_id, g)
  SELECT doc_id, count(*) AS n_runs, min(run) AS first_run FROM r GROUP BY 1""")
def x7_proper_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(tx.proper_runs(F.col("text"), ["the", "le", "der", "el"])).alias("run")).groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.min("run").alias("first_run"))


@query("""WITH r AS (SELECT l_orderkey, list(struct_pack(lo := l_discount, hi := l_discount + l_tax)) AS regions FROM lineitem GROUP BY 1),
  b AS (SELECT l_orderkey, coalesce(list_max(list_transform(list_filter(regions, lambda x: x.hi <= 0.08), lambda x: x.hi)), 0.0) AS top, coalesce(list_min(list_transform(list_filter(regions, lambda x: x.lo >= 0.09), lambda x: x.lo)), 1.0) AS bottom FROM r)
  SELECT l_orderkey, round(top, 6) AS top, round(bottom, 6) AS bottom, bottom - top >= 0.5 AS usable FROM b""")
def x22_x23_strip_bounds(t: Tables) -> DataFrame:
    r = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_discount").alias("lo"), (F.col("l_discount") + F.col("l_tax")).alias("hi"))).alias("regions"))
    top = F.coalesce(F.array_max(F.transform(F.filter("regions", lambda x: x["hi"] <= 0.08), lambda x: x["hi"])), F.lit(0.0))
    bottom = F.coalesce(F.array_min(F.transform(F.filter("regions", lambda x: x["lo"] >= 0.09), lambda x: x["lo"])), F.lit(1.0))
    return r.select("l_orderkey", F.round(top, 6).alias("top"), F.round(bottom, 6).alias("bottom"), (bottom - top >= 0.5).alias("usable"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) % 2 = 0 THEN [o_orderstatus, CAST(year(o_orderdate) AS VARCHAR), 'even'] ELSE [o_orderstatus, CAST(year(o_orderdate) AS VARCHAR)] END AS l,
  len(CASE WHEN year(o_orderdate) % 2 = 0 THEN [1, 2, 3] ELSE [1, 2] END) AS n FROM orders""".replace(" AS l,", "[2] AS label,"))
def x24_year_labels(t: Tables) -> DataFrame:
    y = F.year("o_orderdate").cast("string")
    labels = F.array_union(F.array("o_orderstatus"), F.array(y))
    labels = F.when(F.year("o_orderdate") % 2 == 0, F.array_union(labels, F.array(F.lit("even")))).otherwise(labels)
    return t.orders.select("o_orderkey", labels[1].alias("label"), F.size(labels).alias("n"))


@query("""SELECT n_nationkey, list_slice(regexp_extract_all(n_name, 'NATION_1[0-9]|NATION_2[0-9]|NATION_1'), 1, 2)[1] AS found FROM nation""")
def x26_longest_name_first(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.try_element_at(F.slice(F.regexp_extract_all("n_name", F.lit("(NATION_1[0-9]|NATION_2[0-9]|NATION_1)"), F.lit(1)), 1, 2), F.lit(1)).alias("found"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'versus' WHEN 'view' THEN 'stat' WHEN 'purchase' THEN 'ranking' WHEN 'signup' THEN 'timeline' END AS kind,
  CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup') THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS value, event_type = 'error' AS rejected FROM events""")
def x27_card_specs(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "versus").when(F.col("event_type") == "view", "stat").when(F.col("event_type") == "purchase", "ranking").when(F.col("event_type") == "signup", "timeline")
    return t.events.select("event_id", kind.alias("kind"), F.when(kind.isNotNull(), F.from_json("props", "k int")["k"]).alias("value"), kind.isNull().alias("rejected"))
