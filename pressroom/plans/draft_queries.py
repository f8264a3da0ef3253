"""Drafts, allotments and directions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import drafting, library
from .library_queries import _MATCH, _bits_sql
from .registry import Tables, query

# ------------------------------------------------------------------ near pictures
#: Each vector's hash with its lowest 0 to 8 bits flipped is a copy of the picture.
_COPIES = f"b AS MATERIALIZED (SELECT vec_id, {_bits_sql(1, 64)} AS bits FROM embeddings), cp AS MATERIALIZED (SELECT vec_id, xor(bits, CAST((1 << CAST(vec_id % 9 AS INTEGER)) - 1 AS BIGINT)) AS bits FROM b), lb AS MATERIALIZED (SELECT DISTINCT bits FROM b WHERE vec_id % 2 = 0)"
_KNOWN = f"{_COPIES}, kn AS MATERIALIZED (SELECT vec_id, bool_or(bit_count(xor(cp.bits, lb.bits)) <= 6) AS known FROM cp, lb GROUP BY vec_id)"


def pictures(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", tx.difference_bits(F.col("embedding")).alias("bits"))


def copies(t: Tables) -> DataFrame:
    return pictures(t).withColumn("bits", F.expr("bits ^ (shiftleft(1L, CAST(vec_id % 9 AS INT)) - 1)"))


@query(f"WITH {_KNOWN} SELECT vec_id, known FROM kn")
def j6_known_copies(t: Tables) -> DataFrame:
    """Copies that differ in up to eight bits, against a library of every other picture."""
    return drafting.in_library(copies(t), pictures(t).filter("vec_id % 2 = 0"), "vec_id", {"bits": 6})


@query(f"""WITH {_COPIES}, u AS MATERIALIZED (SELECT vec_id * 2 AS id, bits FROM b UNION ALL SELECT vec_id * 2 + 1, bits FROM cp), n AS MATERIALIZED (SELECT bits, min(id) AS node, count(*) AS c FROM u GROUP BY 1),
  p AS MATERIALIZED (SELECT x.bits, min(y.node) AS first, sum(y.c) AS near FROM n x JOIN n y ON bit_count(xor(x.bits, y.bits)) <= 6 GROUP BY 1)
  SELECT id, least(id, CASE WHEN first < node THEN first ELSE node END) AS match, CAST(near - 1 AS BIGINT) AS links FROM u JOIN n USING (bits) JOIN p USING (bits)""")
def j6_classes_of_copies(t: Tables) -> DataFrame:
    """Pictures and their copies together: first match and links of every row."""
    both = pictures(t).select((F.col("vec_id") * 2).alias("id"), "bits").unionByName(copies(t).select((F.col("vec_id") * 2 + 1).alias("id"), "bits"))
    return library.image_classes(both, "id", "bits", 6)


# ------------------------------------------------------------------ tiered draft
_DRAFT = f"""{_KNOWN},
  e AS MATERIALIZED (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
  hj AS (SELECT event_id, CAST((k + 3 * j) % 40 AS VARCHAR) AS a, (28 - 3 * j - 4 * (k % 3)) / 4.0 AS score FROM e, range(8) t(j)),
  hl AS MATERIALIZED (SELECT event_id, list(a ORDER BY r) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, a) AS r FROM hj) WHERE r <= 6 AND score >= 4 GROUP BY 1),
  wj AS (SELECT event_id, (k * 5 + j * j + user_id * 3) % 500 AS u, k * j % 11 AS health, j FROM e, range(8) t(j)),
  wl AS MATERIALIZED (SELECT event_id, list(struct_pack(u := CAST(u AS VARCHAR), known := coalesce(known, false)) ORDER BY r) AS web FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY health DESC, j) AS r FROM wj) LEFT JOIN kn ON vec_id = u WHERE r <= 6 GROUP BY 1),
  s AS MATERIALIZED (SELECT user_id AS v, event_id AS slot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'view' THEN [CAST(k % 40 AS VARCHAR), CAST(k * 7 % 40 AS VARCHAR)] WHEN 'error' THEN CAST([] AS VARCHAR[]) END AS sem, coalesce(hits, []) AS hits, web FROM e LEFT JOIN hl USING (event_id) JOIN wl USING (event_id)),
  r AS (SELECT v, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS VARCHAR) AS tier, CAST(NULL AS VARCHAR) AS asset, CAST(0 AS BIGINT) AS thrown, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT v FROM s)
    UNION ALL SELECT v, n, slot, CASE WHEN sm IS NOT NULL THEN 'semantic' WHEN ht IS NOT NULL THEN 'library' WHEN w IS NOT NULL THEN 'web' ELSE 'missing' END, coalesce(sm, ht, w), CASE WHEN coalesce(sm, ht) IS NOT NULL THEN 0 WHEN w IS NULL THEN len(op) ELSE p - 1 END, CASE WHEN coalesce(sm, ht) IS NULL THEN taken ELSE list_append(taken, coalesce(sm, ht)) END, CASE WHEN coalesce(sm, ht) IS NULL AND w IS NOT NULL THEN list_append(used, w) ELSE used END
    FROM (SELECT *, op[p].u AS w FROM (SELECT *, list_position(list_transform(op, lambda x: x.known), false) AS p FROM
      (SELECT s.v, s.n, s.slot, taken, used, list_filter(sem, lambda a: NOT list_contains(taken, a))[1] AS sm, CASE WHEN sem IS NULL OR len(sem) > 0 THEN list_filter(hits, lambda a: NOT list_contains(taken, a))[1] END AS ht, list_filter(web, lambda x: NOT list_contains(used, x.u)) AS op FROM r JOIN s ON s.v = r.v AND s.n = r.n + 1))))"""


def draft(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    j, k = F.col("j"), F.col("k")
    many = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
    name = [F.col("user_id").alias("video"), F.col("event_id").alias("slot")]
    lists = e.filter("event_type IN ('view', 'error')").select(*name, F.when(F.col("event_type") == "view", F.array(k % 40, k * 7 % 40)).otherwise(F.array().cast("array<long>")).alias("assets"))
    hits = many.select(*name, ((k + 3 * j) % 40).cast("string").alias("asset"), ((28 - 3 * j - 4 * (k % 3)) / 4.0).alias("score"))
    known = drafting.in_library(copies(t), pictures(t).filter("vec_id % 2 = 0"), "vec_id", {"bits": 6})
    web = many.select(*name, ((k * 5 + j * j + F.col("user_id") * 3) % 500).alias("url"), (k * j % 11).alias("health"), j.alias("seq"))
    web = web.join(known.withColumnRenamed("vec_id", "url"), "url", "left")
    slots = e.select(*name, F.col("event_id").alias("place"))
    return drafting.tiered_draft(slots, lists, hits, web, "video")


@query(f"WITH RECURSIVE {_DRAFT} SELECT v AS video, slot, tier, asset, thrown FROM r WHERE n > 0")
def q7_tiered_draft(t: Tables) -> DataFrame:
    """A video is a user's events; every tier, exclusivity and the J6 test of the web."""
    return draft(t).withColumn("thrown", F.col("thrown").cast("long"))


@query(f"WITH RECURSIVE {_DRAFT} SELECT v AS video, count(*) FILTER (tier IN ('semantic', 'library')) AS library, count(*) FILTER (tier = 'semantic') AS semantic, count(*) FILTER (tier = 'web') AS web, count(*) FILTER (tier = 'missing') AS missing, CAST(sum(thrown) AS BIGINT) AS thrown FROM r WHERE n > 0 GROUP BY 1")
def q7_draft_counters(t: Tables) -> DataFrame:
    return drafting.draft_counters(draft(t), "video")


# ------------------------------------------------------------------ allotment, directions
@query("""WITH n AS (SELECT conv_id, count(*) AS n, greatest(1, count(*) // 2) AS m FROM conversations GROUP BY 1)
  SELECT conv_id, n AS scenes, CASE WHEN n % m = 0 THEN 0 ELSE 1 END AS apart, CASE WHEN m = 1 THEN n - 1 ELSE 0 END AS repeats FROM n""")
def p7_shuffled_allotment(t: Tables) -> DataFrame:
    """The rules that any right answer keeps: every scene has a picture, uses differ by
    one at most, neighbours differ."""
    scenes = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    few = scenes.select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 2)))).alias("picture"))
    dealt = drafting.shuffled_allotment(scenes, few, "conv_id")
    repeat = dealt.withColumn("same", F.lag("picture").over(Window.partitionBy("conv_id").orderBy("place")) == F.col("picture"))
    of = repeat.groupBy("conv_id").agg(F.count_distinct("place").alias("scenes"), F.count_if("same").alias("repeats"))
    uses = dealt.groupBy("conv_id", "picture").agg(F.count("*").alias("c")).groupBy("conv_id").agg((F.max("c") - F.min("c")).cast("int").alias("apart"))
    return of.join(uses, "conv_id").select("conv_id", "scenes", "apart", "repeats")


_STYLE = "CASE WHEN turn % 7 = 5 THEN 'still' WHEN turn % 4 = 3 THEN 'tall' WHEN turn % 3 = 0 THEN 'zoom' ELSE 'pan' END"


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, (conv_id + turn) % 1000 AS start, CASE {_STYLE} WHEN 'tall' THEN ['up'] WHEN 'zoom' THEN ['in', 'out'] WHEN 'pan' THEN ['right', 'left', 'falling', 'rising'] ELSE CAST([] AS VARCHAR[]) END AS c FROM conversations),
  r AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS direction, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT conv_id FROM s)
    UNION ALL SELECT conv_id, n, turn, d, CASE WHEN len(c) > 1 THEN list_append(used, d) ELSE used END FROM (SELECT *, list_sort(list_transform(CASE WHEN len(list_filter(c, lambda x: x IS DISTINCT FROM before)) > 0 THEN list_filter(c, lambda x: x IS DISTINCT FROM before) ELSE c END, lambda x: struct_pack(k := len(list_filter(used, lambda u: u = x)), o := (list_position(c, x) - 1 - start % len(c) + len(c)) % len(c), d := x)))[1].d AS d
      FROM (SELECT s.conv_id, s.n, CAST(s.turn AS BIGINT) AS turn, s.c, s.start, r.used, r.direction AS before FROM r JOIN s ON s.conv_id = r.conv_id AND s.n = r.n + 1)))
  SELECT conv_id, turn, direction FROM r WHERE n > 0""")
def p4_directions(t: Tables) -> DataFrame:
    styled = t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.expr(_STYLE).alias("style"))
    choices = {"tall": ["up"], "zoom": ["in", "out"], "pan": ["right", "left", "falling", "rising"]}
    return drafting.directions(styled, "conv_id", "turn", "style", choices, (F.col("conv_id") + F.col("turn")) % 1000).select("conv_id", "turn", "direction")


# ------------------------------------------------------------------ frames of a video
_FOLDED = _MATCH.format(c="x.label")


@query(f"""WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, list_slice(string_split(text, ' '), 1, 4) AS labels, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS description, CASE WHEN turn % 2 = 0 THEN role END AS subject, turn % 5 = 4 AS overlay, conv_id % 2 = 0 AS cut FROM conversations),
  l AS (SELECT conv_id, i, unnest(labels) AS label, generate_subscripts(labels, 1) AS p FROM f), c AS (SELECT conv_id, i, p, trim(label) AS label FROM l WHERE trim(label) <> ''),
  k AS (SELECT conv_id, list(label ORDER BY i, p)[:12] AS labels FROM (SELECT * FROM c x QUALIFY row_number() OVER (PARTITION BY conv_id, {_FOLDED} ORDER BY i, p) = 1) GROUP BY 1),
  m AS (SELECT conv_id, coalesce(max(CASE WHEN i = n // 2 AND description <> '' THEN description END), min_by(description, i) FILTER (description <> ''), '') AS description, coalesce(max(CASE WHEN i = n // 2 THEN subject END), min_by(subject, i) FILTER (subject IS NOT NULL), '') AS subject, bool_or(cut AND overlay) AS rejected FROM f GROUP BY 1)
  SELECT conv_id, array_to_string(coalesce(labels, []), '|') AS labels, description, subject, rejected FROM m LEFT JOIN k USING (conv_id)""")
def a22_video_labels(t: Tables) -> DataFrame:
    turn = F.col("turn")
    frames = t.conversations.select("conv_id", "turn", F.slice(F.split("text", " "), 1, 4).alias("labels"), F.when(turn % 3 == 1, "").otherwise(F.col("text")).alias("description"), F.when(turn % 2 == 0, F.col("role")).alias("subject"), (turn % 5 == 4).alias("overlay"), (F.col("conv_id") % 2 == 0).alias("cut"))
    return drafting.video_labels(frames, "conv_id", "turn").withColumn("labels", F.array_join("labels", "|"))
