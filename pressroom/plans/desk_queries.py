"""Queries of the script desk: routers, pairings, candidates, scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import api
from ..functions import text as tx
from ..operators import desk, ledgers, library, rules
from ..sources import pictures as sources
from ..sources import readers
from .ledger_queries import timed
from .library_queries import _MATCH, _QUERIES, _SOFT, aliases, asked, assets, rarity_of
from .registry import Tables, query
from .scalars import BARE, HEAD, head
from .stream_queries import folder


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]{3,28})\">', 1))) AS n FROM pages")
def x18_quoted_phrases(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]{3,28})">'), F.lit(1)))).cast("long").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '["“”'']([^"“”'']{3,28})["“”'']', 1), lambda x: trim(x, ' ')) AS quoted, regexp_extract_all(text, '(?i)(\b[0-9]+\s*[-–]\s*[0-9]+\b|\b[0-9]+\s+(?:items|tokens|words|years)\b)', 1) AS counted, regexp_extract_all(text, '([^ \t\n\r\f]+)', 1) AS w FROM documents WHERE text IS NOT NULL),
  s AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '^[,.:;!?"“”'']+|[,.:;!?"“”'']+$', '', 'g')) AS l FROM w), i AS (SELECT *, list_position(list_transform(l, lambda x: contains(x, 'ion') OR contains(x, 'sch') OR contains(x, 'qua')), true) AS i FROM s),
  f AS (SELECT doc_id, w, list_filter(list_concat(list_concat(quoted, counted), CASE WHEN i IS NULL OR i = 0 THEN [] ELSE [regexp_replace(CASE WHEN i > 1 AND l[i - 1] IN ('the', 'le', 'der', 'el') THEN w[i - 1] || ' ' || w[i] WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] ELSE w[i] END, '^[,.:;!?]+|[,.:;!?]+$', '', 'g')] END), lambda x: x <> '') AS f FROM i),
  d AS (SELECT doc_id, w, f[1] AS a, list_filter(f, lambda x: x <> f[1])[1] AS b FROM f), r AS (SELECT doc_id, greatest(1, CAST(floor(len(w) * 0.45) AS INTEGER)) AS room, CASE WHEN b IS NOT NULL AND length(b) < length(a) THEN b ELSE a END AS a, CASE WHEN b IS NOT NULL AND length(b) < length(a) THEN a ELSE b END AS b FROM d),
  n AS (SELECT *, len(regexp_extract_all(a, '([^ \t\n\r\f]+)', 1)) AS na, len(regexp_extract_all(b, '([^ \t\n\r\f]+)', 1)) AS nb FROM r), k AS (SELECT *, coalesce(na <= room, false) AS ka FROM n)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN ka THEN a END, CASE WHEN b IS NOT NULL AND nb + CASE WHEN ka THEN na ELSE 0 END <= room THEN b END], lambda x: x IS NOT NULL), '|') AS phrases FROM k""")
def x18_highlight_phrases(t: Tables) -> DataFrame:
    """Whole texts stand for titles here."""
    found = desk.highlight_phrases(F.col("text"), ["ion", "sch", "qua", "two words"], ["the", "le", "der", "el"], ["items", "tokens", "words", "years"])
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.array_join(found, "|").alias("phrases"))


@query(f"""WITH d AS (SELECT doc_id, {HEAD.format(n=10)} AS title, doc_id % 3 AS people, doc_id % 4 AS teams, doc_id % 5 AS pictures FROM documents)
  SELECT doc_id, CASE WHEN teams >= 2 AND pictures >= 2 THEN 'versus' WHEN regexp_matches(title, '[0-9]+ ?- ?[0-9]+') THEN 'score' WHEN people >= 1 AND pictures >= 2 THEN 'duo' WHEN people >= 1 THEN 'portrait' WHEN regexp_matches(title, '[?]') THEN 'question' ELSE 'plain' END AS layout FROM d""")
def x19_layout_router(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    return t.documents.select("doc_id", desk.layout(head(10), n % 3, n % 4, n % 5).alias("layout"))


LABELS, HEADINGS = ["scene", "part"], ["keywords?", "pictures?"]


@query("""WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, string_split(trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ') AS w FROM conversations)
  SELECT conv_id, CAST(block AS INTEGER) AS block, CASE WHEN conv_id % 3 < 2 THEN 'the line of turn ' || turn || ' ' || array_to_string(w[:8], ' ') END AS quote, 'a longer key ' || w[1] AS plain, 'đa ' || w[1] AS marked, 'key ' || w[1] || '|a longer key ' || w[1] || '|đa ' || w[1] AS keywords FROM w""")
def x29_block_parser(t: Tables) -> DataFrame:
    """An answer a conversation, in one of three forms: labelled blocks, quotations over
    bare lines, and blank lines between lists."""
    w = F.split(F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " ")), " ")
    turn, kind = F.col("turn").cast("string"), F.col("conv_id") % 3
    quote = F.concat(F.lit('"the line of turn '), turn, F.lit(" "), F.array_join(F.slice(w, 1, 8), " "), F.lit('"\n'))
    keys = lambda a, b: F.concat(F.lit(a + "key "), w[0], F.lit("\n" + b + "a longer key "), w[0], F.lit(":\n" + a + "đa "), w[0], F.lit("\n"))
    listed, bare = keys("- ", "2. "), F.replace(keys("", "• "), F.lit(":\n"), F.lit("\n"))
    text = F.when(kind == 0, F.concat(F.lit("**SCENE "), turn, F.lit("**\n"), quote, F.lit("Keywords:\n"), listed, F.lit("This is, of course, told in a sentence.\n"))).when(kind == 1, F.concat(quote, F.lit("\n"), bare)).otherwise(F.concat(listed, F.lit("\n\n")))
    answers = t.conversations.select("conv_id", "turn", text.alias("text")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "").alias("text"))
    return desk.parse_blocks(answers, "conv_id", "text", LABELS, HEADINGS).withColumn("keywords", F.array_join("keywords", "|"))


@query()
def x29_blocks_of_documents(t: Tables) -> DataFrame:
    """Texts as they are: few have blocks."""
    return desk.parse_blocks(t.documents.filter("text IS NOT NULL"), "doc_id", "text", LABELS, HEADINGS).select("doc_id", "block", F.size("keywords").alias("n_lines"))


@query("""WITH r AS (SELECT l_orderkey, max(CASE WHEN l_discount + l_tax <= 0.22 THEN l_discount + l_tax END) AS low FROM lineitem GROUP BY 1) SELECT l_orderkey, round(coalesce(low, 0.0), 6) AS low, 0.5 AS high FROM r""")
def x34_crop_origins(t: Tables) -> DataFrame:
    r = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_discount").alias("lo"), (F.col("l_discount") + F.col("l_tax")).alias("hi"))).alias("regions"))
    return r.select("l_orderkey", desk.free_origins(F.col("regions")).alias("o")).select("l_orderkey", F.round("o.low", 6).alias("low"), F.col("o.high").alias("high"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT DISTINCT lower(p_name) AS f FROM part WHERE p_partkey < 40) SELECT name FROM n WHERE lower(name) NOT IN (SELECT f FROM k)""")
def j11_unknown_names(t: Tables) -> DataFrame:
    known = t.part.filter("p_partkey < 40").select(F.upper("p_name").alias("name"))
    return desk.unknown_names(t.part.select(F.col("p_name").alias("name")).distinct(), known)


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), lower(p_type)) THEN lower(p_name) ELSE lower(p_type) || ' ' || lower(p_name) END AS q FROM part""")
def j11_query_without_name(t: Tables) -> DataFrame:
    q = desk.strip_name(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_brand"), F.col("p_type"))
    return t.part.select("p_partkey", q.alias("q"))


@query()
def j12_excerpt_match(t: Tables) -> DataFrame:
    sentences = t.conversations.select(F.col("conv_id").alias("video"), F.col("turn").alias("i"), "text")
    excerpts = t.conversations.filter("turn % 2 = 0").select(F.col("conv_id").alias("video"), F.col("turn").alias("i"), F.substring("text", 1, 60).alias("text"))
    return desk.match_excerpts(excerpts, sentences, "video")


@query("""SELECT lang, array_to_string(list(url ORDER BY page_id), ' ') AS links FROM (SELECT min(page_id) AS page_id, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, url FROM pages WHERE NOT regexp_matches(url, '//m\\.') GROUP BY 2, 3) WHERE lang <> '' GROUP BY 1""")
def j14_link_gathering(t: Tables) -> DataFrame:
    rows = t.pages.filter(~F.col("url").rlike("//m\\.")).select("page_id", F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang"), "url").filter("lang <> ''")
    one = rows.groupBy("lang", "url").agg(F.min("page_id").alias("page_id"))
    return one.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "url"))), lambda s: s["url"]), " ").alias("links"))


@query("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 2 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")
def j22_ledger_repair(t: Tables) -> DataFrame:
    name = F.concat("l_orderkey", F.lit("__1.0-2.5.mp4"))
    cuts = t.lineitem.filter("l_linenumber = 2").select(F.regexp_extract(name, r"^(\d+)__[\d.]+-[\d.]+\.mp4$", 1).cast("long").alias("l_orderkey")).distinct()
    known = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    origins = t.lineitem.filter("l_linenumber = 1").select("l_orderkey")
    return cuts.join(known, "l_orderkey", "left_anti").join(origins, "l_orderkey", "left_semi")


@query("""SELECT d.doc_id, CASE WHEN toxic = 0 AND quality = 0 THEN 'machine' ELSE d.lang END AS label FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""")
def j23_guarded_update(t: Tables) -> DataFrame:
    seen = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return t.documents.join(seen, "doc_id", "left").select("doc_id", F.when((F.col("toxic") == 0) & (F.col("quality") == 0), "machine").otherwise(F.col("lang")).alias("label"))


@query(f"""WITH f AS (SELECT doc_id, string_split(trim(regexp_replace({BARE.format(c=HEAD.format(n=9))}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), n AS (SELECT DISTINCT array_to_string(list_slice(w, 1, CAST(doc_id % 3 + 1 AS BIGINT)), ' ') AS name FROM f)
  SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name <> '' AND starts_with(b.name, a.name || ' ')""")
def j4_mergeable_names(t: Tables) -> DataFrame:
    folded = F.split(tx.fold_match(head(9)), " ")
    n = t.documents.select(F.array_join(F.slice(folded, 1, (F.col("doc_id") % 3 + 1).cast("int")), " ").alias("name")).filter("name <> ''").distinct()
    first = F.split("name", " ")[0]  # one name starts with the other here, so they share the first word
    pairs = n.select(F.col("name").alias("a"), first.alias("w")).join(n.select(F.col("name").alias("b"), first.alias("w")), "w")
    return pairs.filter(F.col("b").startswith(F.concat("a", F.lit(" "))) & library.mergeable(F.col("a"), F.col("b"), ["u23"])).select("a", "b")


@query("""WITH p AS (SELECT vec_id, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 16) AS INTEGER) AS colour FROM embeddings), c AS (SELECT vec_id, colour, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, colour) AS r FROM c)
  SELECT vec_id, round(sum(CASE WHEN r <= 4 THEN n END) / sum(n), 6) AS share FROM r GROUP BY 1""")
def a20_colour_share(t: Tables) -> DataFrame:
    pixels = t.embeddings.select("vec_id", F.explode("embedding").alias("x")).select("vec_id", F.floor((F.col("x") + 1) * 16).cast("int").alias("colour"))
    return desk.colour_share(pixels, "vec_id", "colour", 4)


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT c.conv_id, max(CASE WHEN turn = n // 2 THEN length(text) END) AS middle, bool_or(role = 'assistant' AND length(text) > 900) AS rejected FROM conversations c JOIN n ON c.conv_id = n.conv_id GROUP BY 1""")
def a22_frame_labels(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return rows.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == F.floor(F.col("n") / 2), F.length("text"))).alias("middle"), F.bool_or((F.col("role") == "assistant") & (F.length("text") > 900)).alias("rejected"))


_PIXELS = "p AS MATERIALIZED (SELECT vec_id, i % 8 AS x, i // 8 AS y, CAST(greatest(0, least(255, floor((v[i + 1] * 2 + 0.5) * 255))) AS BIGINT) AS r, CAST(greatest(0, least(255, floor((v[(i + 9) % 64 + 1] * 2 + 0.5) * 255))) AS BIGINT) AS g, CAST(CASE WHEN vec_id % 4 = 0 THEN 0 ELSE greatest(0, least(255, floor((v[i + 1] + 0.5) * 255))) END AS BIGINT) AS b FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), range(64) t(i))"


def pixels(t: Tables) -> DataFrame:
    """Each vector as a picture of 8 x 8 pixels."""
    byte = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c * 255)))
    v, i = F.transform("embedding", lambda x: x.cast("double")), F.col("i")
    rows = t.embeddings.select("vec_id", v.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    at = lambda k: F.element_at("v", (k + 1).cast("int"))
    return rows.select("vec_id", (i % 8).alias("x"), F.floor(i / 8).alias("y"), byte(at(i) * 2 + 0.5).alias("r"), byte(at((i + 9) % 64) * 2 + 0.5).alias("g"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(byte(at(i) + 0.5)).alias("b"))


@query(f"""WITH {_PIXELS}, c AS (SELECT vec_id, r // 32 * 64 + g // 32 * 8 + b // 32 AS colour, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT vec_id, sum(n) FILTER (k <= 8) / sum(n) AS share FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, colour) AS k FROM c) GROUP BY 1),
  l AS MATERIALIZED (SELECT vec_id, x, y, (299 * r + 587 * g + 114 * b) // 1000 AS l FROM p), e AS (SELECT m.vec_id, sum(CASE WHEN abs(ri.l - le.l) + abs(dn.l - up.l) > 120 THEN 1 ELSE 0 END) / count(*) AS edges FROM l m JOIN l le ON le.vec_id = m.vec_id AND le.y = m.y AND le.x = m.x - 1 JOIN l ri ON ri.vec_id = m.vec_id AND ri.y = m.y AND ri.x = m.x + 1 JOIN l up ON up.vec_id = m.vec_id AND up.x = m.x AND up.y = m.y - 1 JOIN l dn ON dn.vec_id = m.vec_id AND dn.x = m.x AND dn.y = m.y + 1 GROUP BY 1)
  SELECT vec_id, round(share, 6) AS share, round(edges, 6) AS edges, share >= 0.80 OR share >= 0.55 AND edges >= CASE WHEN share >= 0.65 THEN 0.07 ELSE 0.10 END AS graphic FROM s JOIN e USING (vec_id)""")
def a20_colour_profile(t: Tables) -> DataFrame:
    return sources.colour_profile(pixels(t), "vec_id").withColumn("share", F.round("share", 6)).withColumn("edges", F.round("edges", 6))


@query("""WITH p AS (SELECT vec_id, list_transform(range(72), lambda i: CAST(floor((CAST(embedding[i % 64 + 1] AS DOUBLE) + 1) * 127) AS BIGINT)) AS v FROM embeddings), h AS (SELECT vec_id, list_transform(range(64), lambda k: v[k // 8 * 9 + k % 8 + 1] > v[k // 8 * 9 + k % 8 + 2]) AS b FROM p)
  SELECT vec_id, lower(array_to_string(list_transform(range(16), lambda n: substr('0123456789abcdef', 1 + CAST(list_sum(list_transform(range(4), lambda j: CASE WHEN b[4 * n + j + 1] THEN 8 >> CAST(j AS INTEGER) ELSE 0 END)) AS INTEGER), 1)), '')) AS bits FROM h""")
def src8_picture_hashes(t: Tables) -> DataFrame:
    """Each vector as a grey picture of 9 x 8 pixels, in the form of the image source."""
    byte = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.lpad(F.hex(F.floor((F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double") + 1) * 127)), 2, "0"))
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(9).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join(byte, "")).alias("data"))
    return sources.difference_hashes(rows).select(F.col("origin").cast("long").alias("vec_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("bits"))


@query("""SELECT c.conv_id, c.turn, coalesce(d.source, c.role) AS subject FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 10 + c.turn AND d.lang = 'en'""")
def a23_pair_harvest(t: Tables) -> DataFrame:
    lib = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("asset"), "source")
    return t.conversations.withColumn("asset", F.col("conv_id") * 10 + F.col("turn")).join(lib, "asset", "left").select("conv_id", "turn", F.coalesce("source", "role").alias("subject"))


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'pan' ELSE 'zoom' END AS style, (turn * 7 % 5) / 4.0 AS ratio FROM conversations), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, count(*) OVER (PARTITION BY conv_id, style) AS k, row_number() OVER (PARTITION BY conv_id, style ORDER BY CASE WHEN style = 'zoom' THEN -ratio ELSE ratio END, turn) AS r FROM s)
  SELECT conv_id, turn, CASE WHEN n >= 3 AND k > 0.65 * n AND r <= k - floor(0.65 * n) THEN CASE WHEN style = 'zoom' THEN 'pan' ELSE 'zoom' END ELSE style END AS balanced FROM n""")
def w8_balanced_styles(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "pan").otherwise("zoom").alias("style"), (F.col("turn") * 7 % 5 / 4.0).alias("ratio"))
    return desk.balance(rows, "conv_id", "style", "ratio", "turn").select("conv_id", "turn", "balanced")


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'pan' ELSE 'zoom' END AS style, (turn * 7 % 11) / 8.0 AS ratio FROM conversations), u AS (SELECT *, style = 'zoom' AND ratio < 1 AS up FROM s) SELECT conv_id, turn, CASE WHEN up AND row_number() OVER (PARTITION BY conv_id, up ORDER BY ratio, turn) <= sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) // 2 THEN 'tall' ELSE style END AS styled FROM u""")
def w8_vertical_pans(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "pan").otherwise("zoom").alias("style"), (F.col("turn") * 7 % 11 / 8.0).alias("ratio"))
    return desk.vertical_pans(rows, "conv_id", "style", "ratio", "turn").select("conv_id", "turn", "styled")


@query("""WITH RECURSIVE o AS (SELECT user_id, day(ts) AS s, props AS u, min(event_id) AS r FROM events GROUP BY 1, 2, 3), l AS (SELECT user_id, s, list(u ORDER BY r) AS u, row_number() OVER (PARTITION BY user_id ORDER BY s) AS n FROM o GROUP BY 1, 2),
  w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST([] AS VARCHAR[]) AS fresh, CAST([] AS VARCHAR[]) AS seen FROM (SELECT DISTINCT user_id FROM l) UNION ALL SELECT user_id, n, s, fresh, list_concat(seen, fresh) FROM (SELECT l.user_id, l.n, l.s, list_slice(list_filter(l.u, lambda x: NOT list_contains(seen, x)), 1, 2) AS fresh, seen FROM w JOIN l ON l.user_id = w.user_id AND l.n = w.n + 1))
  SELECT user_id, s AS sentence, unnest(fresh) AS url FROM w WHERE n > 0""")
def w10_first_seen_urls(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.dayofmonth("ts").cast("long").alias("sentence"), F.col("event_id").alias("rank"), F.col("props").alias("url"))
    return desk.capped_first_seen(rows, "user_id", "sentence", "rank", "url", 2)


@query("""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS asset, min(struct_pack(i := CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, e := event_id)) AS o FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1, 2), u AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS asset FROM events WHERE event_type = 'purchase'),
  r AS (SELECT user_id, asset, row_number() OVER (PARTITION BY user_id ORDER BY o, asset) AS place FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = e.user_id AND u.asset = e.asset)) SELECT * FROM r WHERE place <= 16""")
def w11_candidate_merge(t: Tables) -> DataFrame:
    rows = t.events.withColumn("asset", F.get_json_object("props", "$.k").cast("int"))
    kinds = [rows.filter(F.col("event_type") == k) for k in ("view", "click", "signup")]
    return desk.merged_candidates(kinds, "user_id", "asset", "event_id", rows.filter("event_type = 'purchase'"))


@query("""SELECT p_partkey, round(least(w * h / 2.5e6, 1.0) * 55 + CASE WHEN w / h BETWEEN 1.3 AND 1.9 THEN 30 WHEN w / h BETWEEN 1.0 AND 2.2 THEN 20 WHEN w / h BETWEEN 0.6 AND 2.6 THEN 8 ELSE 0 END + CASE WHEN regexp_matches(p_name, 'ring') THEN 45 WHEN regexp_matches(p_name, 'gear') THEN -40 ELSE 0 END, 6) AS score FROM (SELECT *, p_size * 50 AS w, p_partkey % 1500 + 100 AS h FROM part)""")
def w14_cover_score(t: Tables) -> DataFrame:
    w, h = F.col("p_size") * 50, F.col("p_partkey") % 1500 + 100
    shape = F.when((w / h).between(1.3, 1.9), 30).when((w / h).between(1.0, 2.2), 20).when((w / h).between(0.6, 2.6), 8).otherwise(0)
    people = F.when(F.col("p_name").rlike("ring"), 45).when(F.col("p_name").rlike("gear"), -40).otherwise(0)
    return t.part.select("p_partkey", F.round(F.least(w * h / 2.5e6, F.lit(1.0)) * 55 + shape + people, 6).alias("score"))


@query("""WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size END AS assigned, round(least(w * h / 2.5e6, 1.0) * 55 + CASE WHEN w / h BETWEEN 1.3 AND 1.9 THEN 30 WHEN w / h BETWEEN 1.0 AND 2.2 THEN 20 WHEN w / h BETWEEN 0.6 AND 2.6 THEN 8 ELSE 0 END + CASE WHEN regexp_matches(p_name, 'ring') THEN 45 WHEN regexp_matches(p_name, 'gear') THEN -40 ELSE 0 END, 6) AS score FROM (SELECT *, p_size * 50 AS w, p_partkey % 1500 + 100 AS h FROM part))
  SELECT p_partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY assigned NULLS LAST, score DESC, p_partkey) AS place FROM s""")
def w14_cover_pictures(t: Tables) -> DataFrame:
    rows = t.part.withColumn("assigned", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size")))
    ranked = rules.cover_pictures(rows, "p_brand", F.col("p_size") * 50, F.col("p_partkey") % 1500 + 100, F.col("p_name").rlike("ring"), F.col("p_name").rlike("gear"), "assigned", "p_partkey")
    return ranked.select("p_partkey", "score", "place")


@query("""WITH o AS (SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, url, min(page_id) AS o FROM pages WHERE NOT regexp_matches(url, '//m\\.') GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY o, url) AS n FROM o WHERE lang <> '')
  SELECT lang, CAST((n - 1) // 16 AS BIGINT) AS part, array_to_string(list(url ORDER BY n), ' ') AS links FROM n GROUP BY 1, 2""")
def j14_link_lists(t: Tables) -> DataFrame:
    rows = t.pages.filter(~F.col("url").rlike("//m\\.")).select("page_id", F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang"), "url").filter("lang <> ''")
    return rules.link_lists(rows, "lang", "url", "page_id", 16)


_FACTOR = f"""gt AS (SELECT doc_id, CASE WHEN contains(l, ' le ') OR contains(l, ' der ') THEN 0.0 WHEN contains(d, ' le ') OR contains(d, ' der ') THEN 0.4 ELSE 1.0 END AS factor FROM (SELECT doc_id, ' ' || {_MATCH.format(c='labels')} || ' ' AS l, ' ' || {_MATCH.format(c='description')} || ' ' AS d FROM a))"""


@query(f"""WITH {_SOFT.format(queries=_QUERIES)}, {_FACTOR}, u AS (SELECT user_id AS doc_id, count(*) AS uses FROM events GROUP BY 1), bo AS (SELECT item_id // 8 AS article, item_id, doc_id, 2 + item_id % 3 AS bonus FROM benchmark, documents WHERE doc_id % 40 = item_id),
  x AS (SELECT item_id // 8 AS article, doc_id, item_id, score FROM so WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id // 8, doc_id ORDER BY score DESC, item_id) = 1),
  y AS (SELECT x.article, x.doc_id, x.item_id, round((score + CASE WHEN x.doc_id % 4 = 0 THEN 4 ELSE 0 END - 2 * least(coalesce(uses, 0), 5) + coalesce(bonus, 0)) * factor, 6) AS total FROM x JOIN gt ON gt.doc_id = x.doc_id AND factor > 0 LEFT JOIN u ON u.doc_id = x.doc_id LEFT JOIN bo ON bo.article = x.article AND bo.item_id = x.item_id AND bo.doc_id = x.doc_id),
  z AS (SELECT *, row_number() OVER (PARTITION BY article, item_id ORDER BY total DESC, doc_id) AS turn FROM y)
  SELECT article, doc_id, item_id, total, row_number() OVER (PARTITION BY article ORDER BY turn, item_id) AS place FROM z QUALIFY place <= 150""")
def q4_library_for_article(t: Tables) -> DataFrame:
    """Every item is a sentence of an article of eight."""
    a = assets(t)
    sentences = asked(t).select(F.floor(F.col("item_id") / 8).alias("article"), F.col("item_id").alias("sentence"), F.col("q").alias("query"))
    teams = t.spark.createDataFrame([("french", "le"), ("german", "der"), ("english", "the")], "team string, alias string")
    gate = library.team_gate(a, "doc_id", "labels", "description", teams, ["english"])
    counts = t.events.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("uses"))
    uses = t.documents.select("doc_id", (F.col("doc_id") % 4 == 0).alias("on_screen")).join(counts, "doc_id", "left")
    bonus = t.documents.select("doc_id", (F.col("doc_id") % 40).alias("sentence")).join(sentences, "sentence").select("article", "sentence", "doc_id", (2 + F.col("sentence") % 3).alias("bonus"))
    rows = api.library_for_article(a, sentences, rarity_of(t), gate, uses, "doc_id", bonus=bonus, alias=aliases(t))
    return rows.select("article", "doc_id", F.col("sentence").alias("item_id"), "total", "place")


@query("""SELECT conv_id, turn, contains(lower(text), ' the ') AND contains(lower(text), ' of ') AS two_teams, regexp_matches(text, '(?i) (but|mais|aber|pero) ') AS contrast, regexp_matches(text, '[0-9]+') AS numbers FROM conversations""")
def q6_two_subject_cues(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.conversations.select("conv_id", "turn", (low.contains(" the ") & low.contains(" of ")).alias("two_teams"), F.col("text").rlike("(?i) (but|mais|aber|pero) ").alias("contrast"), F.col("text").rlike("[0-9]+").alias("numbers"))


@query("""WITH e AS (SELECT user_id, event_id, value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS other, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS v2, event_type FROM events) SELECT event_id, other FROM e WHERE other IS NOT NULL AND event_type <> 'error' AND value >= 40 AND v2 >= 40 AND value <> v2""")
def q8_split_frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.withColumn("other", F.lead("event_id").over(w)).withColumn("v2", F.lead("value").over(w))
    return rows.filter("other IS NOT NULL AND event_type <> 'error' AND value >= 40 AND v2 >= 40 AND value <> v2").select("event_id", "other")


@query("""WITH RECURSIVE p AS (SELECT user_id, (event_id * 37 % 700) / 10.0 AS start, min(event_id) AS picture FROM events GROUP BY 1, 2 HAVING start < 60), z AS (SELECT user_id, start, picture FROM p UNION ALL SELECT user_id, 0.0, NULL FROM p GROUP BY 1 HAVING min(start) > 0),
  c AS MATERIALIZED (SELECT user_id, CAST(start AS DOUBLE) AS start, CAST(lead(start, 1, 60.0) OVER w AS DOUBLE) AS fin, picture, row_number() OVER w AS n FROM z WINDOW w AS (PARTITION BY user_id ORDER BY start)),
  r AS (SELECT user_id, n, start, fin, picture, CAST(0 AS BIGINT) AS lost, CAST(1 AS BIGINT) AS scene FROM c WHERE n = 1
    UNION ALL SELECT c.user_id, c.n, CASE WHEN j THEN r.start ELSE c.start END, c.fin, CASE WHEN j THEN r.picture ELSE c.picture END, CASE WHEN j THEN r.lost + CASE WHEN c.picture IS NULL THEN 0 ELSE 1 END ELSE 0 END, r.scene + CASE WHEN j THEN 0 ELSE 1 END FROM r JOIN (SELECT *, fin - start < 1.0 AS j FROM c) c ON c.user_id = r.user_id AND c.n = r.n + 1)
  SELECT user_id, round(max(start), 6) AS start, round(max(fin), 6) AS "end", max(picture) AS picture, max(lost) AS lost, max(fin) - max(start) > 6 AS long FROM r GROUP BY user_id, scene""")
def p2_scenes(t: Tables) -> DataFrame:
    """A picture an event, at tenths of a second."""
    rows = t.events.select("user_id", (F.col("event_id") * 37 % 700 / 10.0).alias("start"), F.col("event_id").alias("picture"), F.lit(60.0).alias("total"))
    return desk.scenes(rows, "user_id").withColumn("start", F.round("start", 6)).withColumn("end", F.round("end", 6))


@query()
def p6_timed_chop(t: Tables) -> DataFrame:
    return desk.chop(timed(t), "conv_id")


@query("""SELECT p_brand, count(*) AS files FROM part GROUP BY 1""")
def src2_documents_by_folder(t: Tables) -> DataFrame:
    path = folder(t, "docs")
    rows = t.part.select(F.to_json(F.struct("p_partkey", "p_brand")).alias("value"), F.floor(F.col("p_partkey") / 64).alias("g"))  # a document holds 64 at most
    documents = rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = readers.read_docs(t.spark, path, "p_partkey long, p_brand string", "*.txt")
    return found.groupBy("p_brand").agg(F.count("*").alias("files"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 300")
def u1_ledger_append_fold(t: Tables) -> DataFrame:
    twice = t.documents.withColumn("seq", F.lit(1)).unionByName(t.documents.withColumn("seq", F.lit(2)))
    return ledgers.fold(twice, "doc_id", "seq", ["n_chars"]).filter("n_chars >= 300")
