"""Ledger, report and timeline queries over events, conversations, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledgers, rules, timeline
from ..scratch import shared_folder
from ..sources.versions import Versioned
from .registry import Tables, query

NOW = "2024-01-31 00:00:00"
STAGES = ["signup", "view", "click", "error", "purchase"]


def now():
    return F.lit(NOW).cast("timestamp")


def k():
    return F.get_json_object("props", "$.k").cast("int")


@query("""SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(CAST(json_extract_string(props, '$.k') AS INTEGER), CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN event_id END) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0) AS k FROM events GROUP BY user_id""")
def a11_ledger_fold(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", F.when(k() % 2 == 0, k()))
    return ledgers.fold(rows, "user_id", "event_id", ["event_type", "k"])


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind, event_id % 3 <> 1 AS has_kind, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_id % 4 = 2 AS has_k FROM events)
  SELECT CAST(user_id AS VARCHAR) AS user_id, (SELECT kind FROM e x WHERE x.user_id = e.user_id AND has_kind ORDER BY event_id DESC LIMIT 1) AS kind, (SELECT k FROM e x WHERE x.user_id = e.user_id AND has_k ORDER BY event_id DESC LIMIT 1) AS k FROM e GROUP BY user_id""")
def a11_lines_with_nulls(t: Tables) -> DataFrame:
    """A line that gives a field as null clears it; one that leaves it out does not."""
    text = F.concat(F.lit('{"user_id":"'), "user_id", F.lit('"'))
    text = F.concat(text, F.when(F.col("event_id") % 3 == 1, "").when(F.col("event_id") % 5 == 0, ',"kind":null').otherwise(F.concat(F.lit(',"kind":"'), "event_type", F.lit('"'))))
    text = F.concat(text, F.when(F.col("event_id") % 4 == 2, F.concat(F.lit(',"k":"'), F.get_json_object("props", "$.k"), F.lit('"'))).otherwise(""), F.lit("}"))
    return ledgers.fold_lines(t.events.select(text.alias("line"), "event_id"), "line", "event_id", "user_id", ["kind", "k"])


@query("""WITH c AS (SELECT p_partkey, max(k) FILTER (has) AS k, bool_or(has) AS has FROM (SELECT event_id % 300 AS p_partkey, event_id AS k, event_id % 3 > 0 AS has FROM events) GROUP BY 1), l AS (SELECT c.p_partkey, CASE WHEN has THEN CASE WHEN c.k % 3 = 2 THEN NULL ELSE 'k' || c.k END ELSE p.p_name END AS name FROM part p JOIN c USING (p_partkey) UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM c) UNION ALL SELECT c.p_partkey, CASE WHEN has AND c.k % 3 <> 2 THEN 'k' || c.k END FROM c WHERE p_partkey NOT IN (SELECT p_partkey FROM part))
  SELECT p_partkey, name FROM l""")
def snk3_versioned_upsert(t: Tables) -> DataFrame:
    """Parts are written as a version, then changed by events, some of which clear a name."""
    at = Versioned(t.spark, shared_folder(t.spark, "versions"))
    at.write(t.part.select("p_partkey", F.col("p_name").alias("name")))
    name = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("k"), "event_id"))
    given = F.when(F.col("event_id") % 3 > 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))
    at.upsert(t.events.select((F.col("event_id") % 300).alias("p_partkey"), name.alias("name"), given.alias("given"), "event_id"), "p_partkey", ["name"], "event_id", "given")
    return at.read()


@query("""SELECT event_type, value AS median, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = n // 2 + 1""")
def a9_upper_median(t: Tables) -> DataFrame:
    return ledgers.upper_median(t.events, "event_type", "value")


@query("""WITH a AS (SELECT user_id, event_type, list_position(['signup', 'view', 'click', 'error', 'purchase'], event_type) AS place, CASE WHEN event_type = 'purchase' THEN max(ts) ELSE min(ts) END AS moment FROM events GROUP BY 1, 2),
  s AS (SELECT user_id, event_type AS stage, lead(event_type) OVER w AS next, greatest(0.0, (epoch_us(lead(moment) OVER w) - epoch_us(moment)) / 1e6) AS seconds FROM a WINDOW w AS (PARTITION BY user_id ORDER BY place)),
  k AS (SELECT * FROM s WHERE next IS NOT NULL AND seconds >= 0.5)
  SELECT user_id, stage, next, round(seconds, 6) AS seconds, round(100 * seconds / sum(seconds) OVER (PARTITION BY user_id), 4) AS percent FROM k""")
def w5_stage_durations(t: Tables) -> DataFrame:
    return ledgers.stage_durations(t.events, "user_id", "event_type", "ts", STAGES, ["purchase"]).withColumn("seconds", F.round("seconds", 6))


@query("""WITH l AS (SELECT c_custkey AS path, c_nationkey AS size FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS size FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS path FROM customer WHERE c_custkey % 3 = 0),
  a AS (SELECT coalesce(l.path, r.path) AS path, l.path IS NOT NULL AS here, r.path IS NOT NULL AS there, CASE WHEN l.path IS NOT NULL AND r.path IS NOT NULL AND l.size <> r.size THEN 'push' WHEN r.path IS NULL AND b.path IS NOT NULL THEN 'delete_local' WHEN r.path IS NULL THEN 'push' WHEN l.path IS NULL AND b.path IS NOT NULL THEN 'delete_remote' WHEN l.path IS NULL THEN 'pull' END AS action
    FROM l FULL JOIN r ON l.path = r.path LEFT JOIN b ON b.path = coalesce(l.path, r.path)),
  n AS (SELECT count(*) FILTER (here) AS nl, count(*) FILTER (there) AS nr, count(*) FILTER (action = 'pull') AS pulls, count(*) FILTER (action LIKE 'delete%') AS dels FROM a)
  SELECT path, action, CASE WHEN action = 'pull' THEN pulls > 0.15 * greatest(nl, nr) AND pulls > 20 WHEN action LIKE 'delete%' THEN least(nl, nr) < 50 OR dels > 0.15 * greatest(nl, nr) ELSE false END AS refused FROM a, n WHERE action IS NOT NULL""")
def j9_mirror_diff(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("size"))
    remote = c.filter("path % 5 <> 0").withColumn("size", F.when(F.col("path") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return ledgers.mirror_diff(c.filter("path % 7 <> 0"), remote, c.filter("path % 3 = 0"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'PICKED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT 10000000 + s_suppkey, 'NEW', s_acctbal FROM supplier""")
def snk3_upsert(t: Tables) -> DataFrame:
    picked = t.customer.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("PICKED").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    new = t.supplier.select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal"))
    return ledgers.upsert(t.customer, picked.unionByName(new), "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""SELECT o_orderkey, o_custkey % 3 = 0 AS removed FROM orders WHERE o_orderstatus <> 'P'""")
def snk4_soft_delete(t: Tables) -> DataFrame:
    keys = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.filter("o_orderstatus <> 'P'")
    left, gone, _ = ledgers.soft_delete(rows, t.customer.select(F.col("c_custkey").alias("o_custkey")), keys, "o_custkey")
    return left.select("o_orderkey", F.lit(False).alias("removed")).unionByName(gone.select("o_orderkey", F.lit(True).alias("removed")))


@query("""WITH m AS (SELECT user_id, event_type, max_by(props, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), h AS (SELECT user_id, event_type, max_by(CASE WHEN value < 20 THEN '' ELSE props END, event_id) AS v FROM events WHERE event_id % 5 = 1 GROUP BY 1, 2)
  SELECT coalesce(m.user_id, h.user_id) AS user_id, coalesce(m.event_type, h.event_type) AS event_type, CASE WHEN h.v IS NOT NULL AND h.v <> '' THEN h.v ELSE m.v END AS v, CASE WHEN h.v IS NOT NULL AND h.v <> '' THEN 'human' ELSE 'machine' END AS origin FROM m FULL JOIN h ON m.user_id = h.user_id AND m.event_type = h.event_type""")
def j17_precedence_merge(t: Tables) -> DataFrame:
    m = t.events.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("v"))
    h = t.events.filter("event_id % 5 = 1").groupBy("user_id", "event_type").agg(F.max_by(F.when(F.col("value") < 20, "").otherwise(F.col("props")), "event_id").alias("v"))
    return ledgers.precedence_merge(m, h, ["user_id", "event_type"], "v")


@query("""WITH f AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS bytes, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS BIGINT) AS idle FROM lineitem GROUP BY 1),
  d AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'keep' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') <= 700 THEN 'wait' ELSE 'clean' END AS decision FROM orders)
  SELECT d.l_orderkey, coalesce(bytes, 0) AS bytes, CASE WHEN decision = 'clean' THEN coalesce(idle, 0) ELSE 0 END AS reclaimable, decision FROM d LEFT JOIN f ON d.l_orderkey = f.l_orderkey""")
def a12_retention(t: Tables) -> DataFrame:
    jobs = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "P").alias("published"), "o_orderdate")
    files = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_returnflag") == "R").alias("used"))
    return ledgers.retention(jobs, files, "l_orderkey", "published", "o_orderdate", F.lit("2001-12-31").cast("date"), 700)


@query("""SELECT quality AS level, toxic AS confidence, count(*) AS n, GROUPING(quality, toxic) AS grouping FROM labels GROUP BY ROLLUP (quality, toxic)""")
def a7_audit_progress(t: Tables) -> DataFrame:
    return ledgers.audit_progress(t.labels.select(F.col("quality").alias("level"), F.col("toxic").alias("confidence")), "level", "confidence")


@query("""SELECT d.doc_id, coalesce(l.quality, 0) AS level FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.toxic = 1, false) AND d.n_chars >= 300 AND coalesce(l.quality, 0) < 1""")
def f6_audit_worklist(t: Tables) -> DataFrame:
    seen = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = t.documents.join(seen, "doc_id", "left")
    level = F.coalesce("quality", F.lit(0))
    return ledgers.worklist(rows, level, 1, F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("n_chars") < 300).select("doc_id", level.alias("level"))


@query("""SELECT doc_id FROM documents ORDER BY NOT regexp_matches(replace(strip_accents(lower(text)), 'đ', 'd'), 'etait|heron'), doc_id LIMIT 200""")
def f7_priority_filter(t: Tables) -> DataFrame:
    return ledgers.prioritised(t.documents, tx.fold_keep(F.col("text")).rlike("etait|heron"), "doc_id", 200).select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents WHERE n_chars > 500) WHERE r % 3 = 1""")
def f8_shard(t: Tables) -> DataFrame:
    return ledgers.every_nth(t.documents.filter("n_chars > 500"), "doc_id", 1, 3).select("doc_id")


@query("""SELECT user_id, count(*) AS files, max(ts) AS newest FROM events GROUP BY 1""")
def a24_change_signal(t: Tables) -> DataFrame:
    return ledgers.change_signal(t.events, "user_id", "ts")


@query("""SELECT event_type AS recorded, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS was_read, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""")
def a8_suspicion_pairs(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("recorded"), (k() % 7).alias("was_read")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "recorded", "was_read").limit(10)


@query("""WITH l AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) + 3 AS b FROM events WHERE event_type <> 'error')
  SELECT user_id, count(*) AS batches, CAST(sum(a) AS BIGINT) AS fixed, CAST(sum(b) AS BIGINT) AS seen, round(100.0 * sum(a) / sum(b), 4) AS percent FROM l GROUP BY 1""")
def a10_log_scrape(t: Tables) -> DataFrame:
    line = F.when(F.col("event_type") == "error", "Traceback").otherwise(F.concat(F.lit("batch "), "event_id", F.lit(": fixed "), k(), F.lit("/"), k() + 3))
    part = [F.regexp_extract("line", r"batch \d+: fixed (\d+)/(\d+)", i).try_cast("long") for i in (1, 2)]
    rows = t.events.select("user_id", line.alias("line")).select("user_id", part[0].alias("a"), part[1].alias("b")).filter("b IS NOT NULL")
    return rows.groupBy("user_id").agg(F.count("*").alias("batches"), F.sum("a").alias("fixed"), F.sum("b").alias("seen"), F.round(100.0 * F.sum("a") / F.sum("b"), 4).alias("percent"))


@query("""SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 25""")
def a19_leaderboard(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25)


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'error' WHEN min_by(event_type, event_id) = 'error' THEN 'error' WHEN bool_or(value > 300) THEN 'confirm' ELSE 'ok' END AS verdict,
  count(*) FILTER (value > 300) AS flagged FROM events GROUP BY 1""")
def a21_approval_gate(t: Tables) -> DataFrame:
    verdict = F.when(F.count_if(F.col("event_type") == "purchase") == 0, "error").when(F.min_by("event_type", "event_id") == "error", "error").when(F.bool_or(F.col("value") > 300), "confirm").otherwise("ok")
    return t.events.groupBy("user_id").agg(verdict.alias("verdict"), F.count_if(F.col("value") > 300).alias("flagged"))


@query("""WITH p AS (SELECT user_id, max(ts) AS done FROM events WHERE event_type = 'purchase' GROUP BY 1), f AS (SELECT user_id, max(ts) AS filed FROM events WHERE event_type = 'signup' GROUP BY 1)
  SELECT p.user_id, round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(done)) / 3.6e9, 4) AS hours FROM p LEFT JOIN f ON p.user_id = f.user_id WHERE done < TIMESTAMP '2024-01-30 00:00:00' AND (filed IS NULL OR filed < done)""")
def a16_reminders(t: Tables) -> DataFrame:
    done = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("done"))
    filed = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("filed"))
    late = done.join(filed, "user_id", "left").filter((F.col("done") < now() - F.expr("INTERVAL 24 HOURS")) & (F.col("filed").isNull() | (F.col("filed") < F.col("done"))))
    return late.select("user_id", F.round((F.unix_micros(now()) - F.unix_micros(F.col("done").cast("timestamp"))) / 3.6e9, 4).alias("hours"))


@query("""WITH a AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS slot, max_by(event_type, event_id) FILTER (event_id % 2 = 0) AS machine, max_by(event_type, event_id) FILTER (event_id % 2 = 1) AS human FROM events GROUP BY 1, 2)
  SELECT user_id, count(*) AS n_changes, min(slot) AS first_slot FROM a WHERE machine <> human GROUP BY 1""")
def a17_keyword_edits(t: Tables) -> DataFrame:
    even, odd = F.when(F.col("event_id") % 2 == 0, F.col("event_id")), F.when(F.col("event_id") % 2 == 1, F.col("event_id"))
    last = lambda order: t.events.filter(order.isNotNull()).groupBy("user_id", k().alias("slot")).agg(F.max_by("event_type", order).alias("v"))
    edits = rules.keyword_edits(last(even), last(odd), "user_id", "slot", "v")
    return edits.select("user_id", F.size("changes").cast("long").alias("n_changes"), F.col("changes")[0]["slot"].alias("first_slot"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM (SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY 1, 2)) WHERE r <= 14""")
def a18_last_examples(t: Tables) -> DataFrame:
    distinct = t.events.groupBy("user_id", "props").agg(F.min("event_id").alias("event_id"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return distinct.withColumn("r", r).filter("r <= 14").select("user_id", "event_id")


@query("""SELECT conv_id, count(DISTINCT turn // 2) AS sentences, count(DISTINCT CASE WHEN length(text) > 100 THEN turn // 2 END) AS assigned, bool_or(role = 'system') AS flagged FROM conversations GROUP BY 1""")
def a15_job_list(t: Tables) -> DataFrame:
    slot = F.concat(F.floor(F.col("turn") / 2), F.lit(":"), F.col("turn") % 2)
    return rules.job_list(t.conversations, "conv_id", slot, F.length("text") > 100, F.col("role") == "system")


@query("""WITH e AS (SELECT user_id, event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS std FROM events)
  SELECT user_id, count(*) FILTER (abs(value - std) > 46) AS violations, min(event_id) FILTER (abs(value - std) > 46) AS earliest FROM e GROUP BY 1""")
def w6_frame_check(t: Tables) -> DataFrame:
    std = F.first("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    off = F.abs(F.col("value") - F.col("std")) > 46
    return t.events.withColumn("std", std).groupBy("user_id").agg(F.count_if(off).alias("violations"), F.min(F.when(off, F.col("event_id"))).alias("earliest"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d') || '-' || row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS code FROM events""")
def w9_day_sequence(t: Tables) -> DataFrame:
    return rules.day_codes(t.events.select("event_id", "ts"), "ts", "event_id").select("event_id", "code")


@query("""SELECT p_partkey, p_brand, uses, pick FROM (SELECT p_partkey, p_brand, uses, row_number() OVER (PARTITION BY p_brand ORDER BY uses, md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS pick FROM (SELECT p_partkey, p_brand, count(l_orderkey) AS uses FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2)) WHERE pick <= 3""")
def w7_least_repeat(t: Tables) -> DataFrame:
    uses = t.part.join(t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("u")), "p_partkey", "left").select("p_partkey", "p_brand", F.coalesce("u", F.lit(0)).alias("uses"))
    pick = F.row_number().over(Window.partitionBy("p_brand").orderBy("uses", F.md5(F.col("p_partkey").cast("string")), "p_partkey"))
    return uses.withColumn("pick", pick).filter("pick <= 3")


@query("""SELECT o_custkey, count(*) AS uses, -2 * least(count(*), 5) + CASE WHEN o_custkey % 2 = 0 THEN 4 ELSE 5 END AS bonus FROM orders GROUP BY 1""")
def w12_rotation_penalty(t: Tables) -> DataFrame:
    uses = t.orders.groupBy("o_custkey").agg(F.count("*").alias("uses"))
    return uses.withColumn("bonus", rules.rotation_bonus(F.col("uses"), F.col("o_custkey") % 2 == 0))


_TIMES = """t AS (SELECT conv_id, turn, role, text, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS words FROM conversations),
  e AS (SELECT *, round(sum(words) OVER (PARTITION BY conv_id ORDER BY turn) * 60.0 / greatest(sum(words) OVER (PARTITION BY conv_id), 1), 2) AS "end" FROM t),
  s AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY conv_id ORDER BY turn), 0.0) AS start FROM e),
  p AS (SELECT *, CASE WHEN turn % 3 = 0 THEN turn END AS picture FROM s),
  c AS (SELECT *, last_value(picture IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM p)"""


def timed(t: Tables) -> DataFrame:
    rows = timeline.sentence_times(t.conversations, "conv_id", "turn", "text", F.lit(60.0))
    return timeline.carry_forward(rows.withColumn("picture", F.when(F.col("turn") % 3 == 0, F.col("turn"))), "conv_id", "turn", "picture")


@query(f"""WITH {_TIMES} SELECT conv_id, turn, words, start, "end", round("end" - start, 2) AS length, shown, greatest(1, CAST(floor((round("end" - start, 2) + 0.01) / 2.5) AS INTEGER)) AS ceiling FROM c""")
def w1_w16_w17_j18_timeline(t: Tables) -> DataFrame:
    return timed(t).select("conv_id", "turn", F.col("words").cast("long").alias("words"), "start", "end", "length", "shown", timeline.slot_ceiling(F.col("length")).alias("ceiling"))


@query(f"""WITH {_TIMES}, n AS (SELECT *, CASE WHEN shown IS NOT DISTINCT FROM lag(shown) OVER (PARTITION BY conv_id ORDER BY turn) AND turn > 0 THEN 0 ELSE 1 END AS f FROM c), r AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n)
  SELECT conv_id, min(start) AS start, max("end") AS "end", min(shown) AS picture, count(*) AS sentences FROM r GROUP BY conv_id, run HAVING min(shown) IS NOT NULL AND max("end") - min(start) > 6""")
def w4_long_stills(t: Tables) -> DataFrame:
    return timeline.long_stills(timed(t), "conv_id", "turn", "shown")


@query(f"""WITH {_TIMES}, g AS (SELECT conv_id, i AS scene, i * 10.0 AS b, (i + 1) * 10.0 AS k FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 6) r(i))
  SELECT c.conv_id, turn, scene FROM c LEFT JOIN g ON c.conv_id = g.conv_id AND c.start >= b AND c.start < k""")
def j19_interval_join(t: Tables) -> DataFrame:
    scenes = t.conversations.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<long>")).alias("scene"))
    scenes = scenes.select("conv_id", "scene", (F.col("scene") * 10.0).alias("start"), ((F.col("scene") + 1) * 10.0).alias("end"))
    return timeline.active_at(timed(t).select("conv_id", "turn", F.col("start").alias("at")), scenes, "conv_id", "at").select("conv_id", "turn", "scene")


@query("""WITH n AS (SELECT event_id, value, CASE WHEN value < 8 THEN 0 ELSE greatest(3, least(14, CAST(floor(value / 6) AS INTEGER))) END AS n FROM events)
  SELECT event_id, n AS marks, CASE WHEN n > 0 THEN round(value * 1 / (n + 1), 6) END AS first_mark FROM n""")
def p5_even_marks(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", timeline.even_marks(F.col("value")).alias("m"))
    return rows.select("event_id", F.size("m").alias("marks"), F.try_element_at("m", F.lit(1)).alias("first_mark"))


@query("""WITH n AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, turn % greatest(1, n // 2) AS item FROM n""")
def p7_ordered_allotment(t: Tables) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return t.conversations.select("conv_id", "turn", F.pmod(F.col("turn"), F.greatest(F.lit(1).cast("long"), F.floor(n / 2))).alias("item"))


@query()
def p1_pacing(t: Tables) -> DataFrame:
    rows = timed(t).select("conv_id", "turn", "length", (F.col("turn") % 5 == 4).alias("is_clip"), (F.col("turn") % 3).cast("int").alias("extra"))
    return timeline.pace(rows, "conv_id", "turn")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def snk4_fingerprints_left(t: Tables) -> DataFrame:
    prints = t.customer.select("c_custkey", "c_acctbal")
    return ledgers.soft_delete(prints, prints, t.customer.filter("c_custkey % 3 = 0"), "c_custkey")[2].select("c_custkey")


@query("""WITH RECURSIVE p AS (SELECT user_id, list(DISTINCT value % 60 ORDER BY value % 60) AS l FROM events GROUP BY 1),
  r AS (SELECT user_id, 1 AS n, l, CAST([0.0] AS DOUBLE[]) AS c FROM p UNION ALL SELECT user_id, n + 1, l, CASE WHEN l[n] > 0.5 AND l[n] < 59.5 AND l[n] - c[len(c)] >= 1.5 AND len(c) < 60 THEN list_append(c, l[n]) ELSE c END FROM r WHERE n <= len(l)),
  e AS (SELECT user_id, CASE WHEN len(c) > 1 AND 60 - c[len(c)] < 1.5 THEN c[:len(c) - 1] ELSE c END AS c FROM r WHERE n = len(l) + 1)
  SELECT user_id, round(c[i], 6) AS start, round(coalesce(c[i + 1], 60.0), 6) AS "end" FROM e, range(1, 61) t(i) WHERE i <= len(c)""")
def p3_segment_merge(t: Tables) -> DataFrame:
    points = t.events.select("user_id", (F.col("value") % 60).alias("at"), F.lit(60.0).alias("length"))
    return timeline.merge_points(points, "user_id", "at", "length").select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, (conv_id * 7 + turn * 13) % 101 AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), o AS (SELECT conv_id, p, n, row_number() OVER (PARTITION BY conv_id ORDER BY d, p) AS k FROM s WHERE p > 1 AND p < n),
  r AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS c FROM (SELECT DISTINCT conv_id FROM s) UNION ALL SELECT r.conv_id, o.k, CASE WHEN len(c) < round_even(n * 0.3, 0) AND NOT list_contains(c, p - 1) AND NOT list_contains(c, p + 1) THEN list_append(c, p) ELSE c END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1), l AS (SELECT conv_id, max_by(c, k) AS c FROM r GROUP BY 1)
  SELECT conv_id, turn, list_contains(c, p) AS clip FROM s JOIN l USING (conv_id)""")
def p4_clip_spread(t: Tables) -> DataFrame:
    return timeline.spread(t.conversations, "conv_id", "turn", draw=(F.col("conv_id") * 7 + F.col("turn") * 13) % 101)


@query("""WITH j AS (SELECT o_orderkey AS job, CAST(o_orderdate AS DATE) AS day, 'Order No. ' || o_orderkey % 400 AS title, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 40 AS INTEGER)) AS rendered, o_orderstatus = 'F' AS filed FROM orders), m AS (SELECT max(day) AS m FROM j), d AS (SELECT DISTINCT day FROM j ORDER BY day DESC LIMIT 4)
  SELECT job, day, title FROM j, m WHERE day IN (SELECT day FROM d) AND NOT filed AND rendered < CAST(m AS TIMESTAMP) + INTERVAL 40 HOUR - INTERVAL 24 HOUR AND job % 400 % 3 > 0 ORDER BY day DESC, job LIMIT 5""")
def a16_due_jobs(t: Tables) -> DataFrame:
    """Orders as jobs; every third title is in the catalog, spelt otherwise."""
    n = F.col("o_orderkey")
    jobs = t.orders.select(n.alias("job"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("Order No. "), n % 400).alias("title"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(n % 40).cast("int"))).alias("rendered"), (F.col("o_orderstatus") == "F").alias("filed"))
    catalog = t.orders.filter("o_orderkey % 400 % 3 = 0").select(F.concat(F.lit("ORDER: no "), n % 400, F.lit("!")).alias("title")).distinct()
    last = t.orders.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    return ledgers.reminders(jobs, catalog, F.lit(last).cast("timestamp") + F.make_interval(hours=F.lit(40)))


@query("""WITH l AS (SELECT user_id, event_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 14) SELECT user_id, min(event_id) AS event_id, props FROM l WHERE props <> '{}' AND props <> '' GROUP BY 1, 3""")
def a18_examples_of_the_last(t: Tables) -> DataFrame:
    return ledgers.last_examples(t.events.withColumn("props", F.when(F.col("props") != "{}", F.col("props"))), "user_id", "event_id", "props")


@query("""WITH l AS (SELECT user_id, event_id, [event_type || '>' || k FOR k IN range(event_id % 5)] AS c FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 6), f AS (SELECT user_id, flatten(list(c[:3] ORDER BY event_id)) AS c FROM l GROUP BY 1), k AS (SELECT user_id, c[greatest(1, len(c) - 7):] AS c FROM f)
  SELECT user_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS place, unnest(c) AS change FROM k""")
def a18_last_edits(t: Tables) -> DataFrame:
    many = F.sequence(F.lit(0), F.greatest((F.col("event_id") % 5).cast("int") - 1, F.lit(0)))
    changes = F.when(F.col("event_id") % 5 > 0, F.transform(many, lambda k: F.concat("event_type", F.lit(">"), k))).otherwise(F.array().cast("array<string>"))
    return ledgers.last_edits(t.events.withColumn("c", changes), "user_id", "event_id", "c")


@query("""SELECT user_id, max_by(props, struct_pack(click := event_type = 'click', e := event_id)) AS props FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""")
def j26_provenance_merge(t: Tables) -> DataFrame:
    one = t.events.filter("event_type = 'view'").select("user_id", "props", F.lit(0).alias("book"), "event_id")
    two = t.events.filter("event_type = 'click'").select("user_id", "props", F.lit(1).alias("book"), "event_id")
    return one.unionByName(two).groupBy("user_id").agg(F.max_by("props", F.struct("book", "event_id")).alias("props"))


@query("""WITH a AS (SELECT user_id, event_type, max_by(props, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, max_by(props, event_id) AS v FROM events WHERE event_id % 2 = 0 OR value > 150 GROUP BY 1, 2)
  SELECT coalesce(a.user_id, b.user_id) AS user_id, bool_and(a.v IS NOT DISTINCT FROM b.v) AS current FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1""")
def j25_map_is_current(t: Tables) -> DataFrame:
    a = t.events.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("a"))
    b = t.events.filter("event_id % 2 = 0 OR value > 150").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("b"))
    return rules.same_maps(a.withColumnRenamed("a", "v"), b.withColumnRenamed("b", "v"), "user_id", "event_type", "v")


@query("""SELECT e.event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'removed' WHEN event_type = 'error' THEN 'kept' ELSE 'match' END AS outcome FROM events e""")
def j24_verdicts(t: Tables) -> DataFrame:
    machine = F.col("user_id") % 2 == 0
    return t.events.select("event_id", F.when((F.col("event_type") == "error") & machine, "removed").when(F.col("event_type") == "error", "kept").otherwise("match").alias("outcome"))


@query("""WITH v AS (SELECT event_id, max(seen) AS seen FROM (SELECT event_id * 3 % 5000 AS event_id, event_type AS seen FROM events WHERE event_type <> 'error') GROUP BY 1) SELECT e.event_id, CASE WHEN v.event_id IS NULL THEN 'unseen' WHEN seen = event_type THEN 'match' WHEN user_id % 2 = 0 THEN 'removed' ELSE 'kept' END AS outcome FROM events e LEFT JOIN v ON v.event_id = e.event_id""")
def j24_verdict_join(t: Tables) -> DataFrame:
    """Events as pictures, looked at again by other events."""
    eye = t.events.filter("event_type <> 'error'").select((F.col("event_id") * 3 % 5000).alias("event_id"), F.col("event_type").alias("seen_as"))
    return rules.verdict_outcomes(t.events.withColumn("by_machine", F.col("user_id") % 2 == 0), eye, "event_id", "event_type")
