"""Group F: windows and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.operators import sequences as Q
from offergrid.operators.options import physical
from offergrid.plans.registry import query

c = F.col


@query("f1_first_per_key", "SELECT physical, min(listing_id) AS listing_id, arg_min(course_code, listing_id) AS course_code FROM lst GROUP BY 1")
def f1(v):
    rows = physical(v.listings("order", "part")).select("physical", "listing_id", "course_code")
    return Q.first_per_key(rows, ["physical"], [c("listing_id")])


@query("f2_carry_forward", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS label,
 last_value(CASE WHEN length(text) > 400 THEN turn END IGNORE NULLS) OVER w AS long_turn FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def f2(v):
    rows = v.table("conversations").select("conv_id", "turn", F.when(c("role") == "user", c("text")).alias("label"),
                                           F.when(F.length("text") > 400, c("turn")).alias("long_turn"))
    return Q.carry_forward(rows, ["conv_id"], [c("turn").asc()], ["label", "long_turn"], block=3).drop("pos")


@query("f3_running_group", """
SELECT conv_id, turn, greatest(sum((length(text) > 300)::INT) OVER (PARTITION BY conv_id ORDER BY turn), 1)::BIGINT AS grp FROM conversations""")
def f3(v):
    rows = v.table("conversations").select("conv_id", "turn", (F.length("text") > 300).alias("is_label"))
    return Q.running_group(rows, ["conv_id"], [c("turn").asc()], c("is_label"), block=3).drop("pos", "is_label")


@query("f4_option_signature", """
WITH m AS (SELECT l_orderkey, l_suppkey::VARCHAR AS class_number, min(l_linenumber) AS p FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, string_agg(class_number, '+' ORDER BY class_number) AS signature,
 arg_min(class_number, struct_pack(p, class_number)) AS f FROM m GROUP BY 1)
SELECT l_orderkey, class_number, signature, class_number = f AS is_primary FROM m JOIN s USING (l_orderkey)""")
def f4(v):
    rows = v.table("lineitem").select("l_orderkey", c("l_suppkey").cast("string").alias("class_number"), "l_linenumber")
    return Q.option_signature(rows, ["l_orderkey"], "class_number", "l_linenumber")


def document_lines(v):
    """Lines of every document; one to three words make a heading of that level."""
    words = F.size(F.split(F.trim("line"), " +"))
    return (v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter(F.trim("line") != "").withColumn("level", F.when(words <= 3, words)))


_LINES = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, line, len(string_split_regex(trim(line), ' +')) AS n FROM l WHERE trim(line) <> ''),
w AS (SELECT *, max(CASE WHEN n = 1 THEN pos END) OVER s AS p1, max(CASE WHEN n = 2 THEN pos END) OVER s AS p2,
 max(CASE WHEN n = 3 THEN pos END) OVER s AS p3 FROM k WINDOW s AS (PARTITION BY doc_id ORDER BY pos)),
ctx AS (SELECT w.doc_id, w.pos, w.line, concat_ws(' > ', CASE WHEN p3 > coalesce(p2, -1) AND p3 > coalesce(p1, -1) THEN c.line END,
 CASE WHEN p2 > coalesce(p1, -1) THEN b.line END, a.line) AS labels FROM w
 LEFT JOIN k a ON a.doc_id = w.doc_id AND a.pos = p1 LEFT JOIN k b ON b.doc_id = w.doc_id AND b.pos = p2
 LEFT JOIN k c ON c.doc_id = w.doc_id AND c.pos = p3 WHERE w.n > 3)"""


@query("f5_heading_context", _LINES + " SELECT doc_id, pos::INT AS pos, labels FROM ctx")
def f5(v):
    return Q.heading_context(document_lines(v), "doc_id", "pos", "level", "line").select(
        "doc_id", "pos", F.array_join("labels", " > ").alias("labels"))


_TRIES = """
WITH e AS (SELECT *, CASE WHEN event_type IN ('error', 'signup', 'view') THEN CASE WHEN k < 70 THEN 'timeout' ELSE 'parse' END END AS failure,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM upd),
g AS (SELECT *, CASE WHEN failure IS NULL OR failure IS DISTINCT FROM lag(failure) OVER (PARTITION BY user_id ORDER BY pos) THEN pos END AS st FROM e),
streaks AS (SELECT user_id, event_id, ts, failure, pos, CASE WHEN failure IS NULL THEN 0 ELSE pos - max(st) OVER (PARTITION BY user_id ORDER BY pos) + 1 END AS streak FROM g)"""


def attempts(v):
    bad = c("event_type").isin("error", "signup", "view")
    return v.updates().select("user_id", "event_id", "ts", F.when(bad, F.when(c("k") < 70, "timeout").otherwise("parse"))
                              .alias("failure"))


@query("f6_failure_streaks", _TRIES + " SELECT user_id, event_id, streak, streak >= 3 AS broken FROM streaks")
def f6(v):
    out = Q.failure_streaks(attempts(v), ["user_id"], [c("ts").asc(), c("event_id").asc()], "failure", block=20)
    return out.select("user_id", "event_id", "streak", (c("streak") >= 3).alias("broken"))


@query("f7_recent_durations", """
SELECT event_id, round(avg(value) OVER w, 4) AS mean, list_sort(list(value) OVER w)[ceil(len(list(value) OVER w) * 95 / 100)::INT] AS p95
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def f7(v):
    out = Q.recent_stats(v.table("events").select("event_id", "ts", "value"), [], [c("ts").asc(), c("event_id").asc()],
                         "value", 100, block=1000)
    return out.select("event_id", F.round("mean", 4).alias("mean"), "p95")


def sources(v):
    """One source per supplier and term, with what the events say about it."""
    ev = v.updates()
    seen = ev.groupBy(c("user_id").alias("l_suppkey")).agg(
        F.max(F.when(c("kind").isin("open", "closed"), c("ts"))).alias("last_success"), F.max("ts").alias("last_attempt"),
        F.max(F.when((c("kind") == "failure") & (c("k") > 90), c("ts"))).alias("bad"),
        (F.count_if((c("kind") == "unknown") & (c("k") > 97)) > 0).alias("manual"),
        (F.count_if((c("kind") == "waitlist") & (c("k") > 95)) > 0).alias("viewed"))
    pages = v.listings("order").select(F.concat_ws("/", "source_url", F.replace("term", F.lit(" "), F.lit("-")))
                                       .alias("source_url"), "term", "l_suppkey").distinct()
    return pages.join(seen, "l_suppkey", "left").select(
        "source_url", "term", "last_success", "last_attempt", (c("bad") + F.expr("INTERVAL 3 DAYS")).alias("retry_after"),
        F.coalesce("manual", F.lit(False)).alias("manual"), F.coalesce("viewed", F.lit(False)).alias("viewed"))


@query("f8_refresh_queue", """
WITH seen AS (SELECT user_id, max(ts) FILTER (WHERE kind IN ('open', 'closed')) AS ok, max(ts) AS att,
  max(ts) FILTER (WHERE kind = 'failure' AND k > 90) + INTERVAL 3 DAY AS retry, count(*) FILTER (WHERE kind = 'unknown' AND k > 97) > 0 AS manual,
  count(*) FILTER (WHERE kind = 'waitlist' AND k > 95) > 0 AS viewed FROM upd GROUP BY 1),
pg AS (SELECT DISTINCT source_url || '/' || replace(term, ' ', '-') AS source_url, term, l_suppkey FROM lst),
t AS (SELECT source_url, term, ok, att, CASE WHEN manual THEN 1 WHEN viewed AND coalesce(retry <= TIMESTAMP '2024-01-18', true)
   AND coalesce(epoch(TIMESTAMP '2024-01-18') - epoch(att) >= 180, true) THEN 2 WHEN coalesce(retry <= TIMESTAMP '2024-01-18', true) THEN 3 END AS tier
   FROM pg LEFT JOIN seen ON user_id = l_suppkey),
q AS (SELECT *, CASE WHEN tier < 3 THEN tier WHEN term = 'Spring 1998' THEN 3 ELSE 4 END AS pool FROM t WHERE tier IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY pool, CASE WHEN pool = 4 THEN term ELSE '' END ORDER BY CASE WHEN pool = 2 THEN att ELSE ok END NULLS FIRST, source_url) AS rn FROM q),
p AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY rn, CASE WHEN pool = 4 THEN term ELSE '' END) AS prn FROM r)
SELECT source_url, term, tier, row_number() OVER (ORDER BY tier, CASE pool WHEN 3 THEN prn + (prn - 1) // 4 WHEN 4 THEN prn * 5 ELSE prn END) AS queue_pos FROM p""")
def f8(v):
    return Q.refresh_queue(sources(v), F.lit("2024-01-18 00:00:00").cast("timestamp"), "Spring 1998")
