"""Matching (D8-D10, E33, H6) and schedules (D7, M1, M2, M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.operators import calendar as C
from offergrid.operators import matching as M
from offergrid.plans.registry import query

c = F.col
FORMS = ("exact", "middle", "longer", "alias", "accent", "other", "typo")


def people(v):
    """Targets are the part names; candidates are variants of them, by size."""
    part = v.table("part")
    given, last = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), 2)
    form = c("p_size") % 7
    said = (F.when(form == 0, F.concat(last, F.lit(", "), F.upper(given)))
            .when(form == 1, F.concat(F.lit("Max "), c("p_name")))
            .when(form == 2, F.concat(given, F.lit("ington "), last))
            .when(form == 3, F.concat(F.lit("tiny "), last))
            .when(form == 4, F.translate("p_name", "aeo", "áéö"))
            .when(form == 5, F.concat(given, F.lit(" smith")))
            .otherwise(F.overlay("p_name", F.lit("q"), F.lit(2))))
    targets = part.select(c("p_name").alias("target_id"), c("p_name").alias("name")).distinct()
    cands = part.select(F.concat(said, F.lit("@"), c("p_brand")).alias("cand_id"), said.alias("name")).distinct()
    aliases = part.filter(given == "small").select(c("p_name").alias("name"), F.concat(F.lit("tiny "), last).alias("alias"))
    t_courses = part.filter(form == 0).select(c("p_name").alias("target_id"), F.concat(c("p_type"), F.lit("/"), c("p_size"))
                                              .alias("course"))
    c_courses = part.filter(form != 0).select(F.concat(said, F.lit("@"), c("p_brand")).alias("cand_id"),
                                              F.concat(c("p_type"), F.lit("/"), (c("p_size") + 1)).alias("course"))
    exact = part.filter((form == 0) & (c("p_size") < 10)).select(
        F.concat(said, F.lit("@"), c("p_brand")), F.concat(c("p_type"), F.lit("/"), c("p_size")))
    return targets, cands, aliases.distinct(), t_courses, c_courses.union(exact)


_PEOPLE = """
WITH p AS (SELECT *, string_split(p_name, ' ')[1] AS g, string_split(p_name, ' ')[2] AS l, p_size % 7 AS f FROM part),
said AS (SELECT *, CASE f WHEN 0 THEN l || ', ' || upper(g) WHEN 1 THEN 'Max ' || p_name WHEN 2 THEN g || 'ington ' || l WHEN 3 THEN 'tiny ' || l
 WHEN 4 THEN translate(p_name, 'aeo', 'áéö') WHEN 5 THEN g || ' smith' ELSE p_name[1] || 'q' || p_name[3:] END AS name FROM p),
cands AS (SELECT DISTINCT name || '@' || p_brand AS cand_id, f, g, l, p_name FROM said),
t AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[1] AS tg, string_split(p_name, ' ')[2] AS tl FROM part),
s0 AS (SELECT t.p_name AS target_id, cand_id, CASE WHEN tl <> l THEN 0 WHEN f IN (0, 4) AND tg = g THEN 1.0
  WHEN f = 1 AND tg = g THEN 0.98 WHEN f = 2 AND tg = g AND length(g) >= 4 THEN 0.94 WHEN f = 3 AND tg = 'small' THEN 0.99
  WHEN f = 6 AND tg = g AND (length(t.p_name) - 1) / length(t.p_name) >= 0.82 THEN least(0.88, (length(t.p_name) - 1) / length(t.p_name)) ELSE 0 END AS score
 FROM t JOIN cands ON tl = l WHERE f <> 5),
scored AS (SELECT target_id, cand_id, max(score)::DOUBLE AS score FROM s0 WHERE score > 0 GROUP BY ALL)"""


@query("d8_match_people", _PEOPLE + " SELECT target_id, cand_id, round(score, 6) AS score FROM scored")
def d8(v):
    targets, cands, aliases, _, _ = people(v)
    return M.match_people(targets, cands, aliases).withColumn("score", F.round("score", 6))


_PICK = _PEOPLE + """,
tc AS (SELECT DISTINCT p_name AS target_id, p_type || '/' || p_size AS course FROM said WHERE f = 0),
cc AS (SELECT DISTINCT name || '@' || p_brand AS cand_id, p_type || '/' || (p_size + 1) AS course FROM said WHERE f <> 0
 UNION SELECT name || '@' || p_brand, p_type || '/' || p_size FROM said WHERE f = 0 AND p_size < 10),
b AS (SELECT target_id, max(score) AS best FROM scored GROUP BY 1),
ti AS (SELECT s.target_id, cand_id, best FROM scored s JOIN b ON s.target_id = b.target_id WHERE abs(score - best) < 1e-9),
n AS (SELECT target_id, count(*) AS ties, min(cand_id) AS lone, min(best) AS best FROM ti GROUP BY 1),
sh AS (SELECT target_id, count(DISTINCT cand_id) AS hits, min(cand_id) AS by_course FROM ti JOIN tc USING (target_id) JOIN cc USING (cand_id, course)
 WHERE target_id IN (SELECT target_id FROM n WHERE ties > 1) GROUP BY 1),
pick AS (SELECT t.p_name AS target_id, CASE WHEN ties IS NULL THEN 'no_name_match' WHEN ties = 1 THEN 'matched' WHEN hits = 1 THEN 'matched_by_course' ELSE 'ambiguous_name' END AS outcome,
 CASE WHEN ties = 1 THEN lone WHEN hits = 1 THEN by_course END AS cand_id, CASE WHEN ties = 1 THEN best WHEN hits = 1 THEN least(1.0, best + 0.01) END AS score
 FROM t LEFT JOIN n ON n.target_id = t.p_name LEFT JOIN sh ON sh.target_id = t.p_name)"""


def picks(v):
    targets, cands, aliases, t_courses, c_courses = people(v)
    return M.pick_match(targets, M.match_people(targets, cands, aliases), t_courses, c_courses)


@query("d9_pick_match", _PICK + " SELECT target_id, cand_id, round(score, 6) AS score, outcome FROM pick")
def d9(v):
    return picks(v).withColumn("score", F.round("score", 6))


def registry(v):
    part = v.table("part")
    name = F.concat(F.initcap("p_name"), F.lit(", "), c("p_type"))
    kind = F.length("p_name") % 4
    degree = F.when(kind == 0, ", B.A.").when(kind == 1, ", B.S.").otherwise("")
    plan = F.concat_ws("|", "p_name", "p_type")
    own = part.select(plan.alias("plan_code"), F.lit(0).alias("idx"), F.concat(name, degree).alias("name"))
    alias = part.filter(kind == 3).select(plan, F.lit(1), F.concat(name, F.lit(" Emphasis, B.M."))).distinct()
    base = F.concat(F.initcap("p_name"), F.lit(" &amp; "), c("p_type"))
    scraped = part.filter("p_size < 45").select(F.explode(F.array(
        F.when(kind == 0, F.concat(name, F.lit(", B.A."))), F.when(kind == 1, F.concat(F.lit("The "), base, F.lit(" (B.S.)"))),
        F.when(kind == 2, F.concat(name, F.lit(" Major in B.A."))),
        F.when((kind == 2) & (c("p_type") == "SMALL"), F.concat(name, F.lit(", B.F.A."))),
        F.when(kind == 3, F.concat(name, F.lit(" emphasis B.M."))),
        F.concat(F.lit("Left over "), c("p_type")))).alias("scraped")).filter("scraped IS NOT NULL").distinct()
    return own.union(alias).distinct(), scraped


_REG = """
WITH p AS (SELECT DISTINCT p_name, p_type, length(p_name) % 4 AS k FROM part),
s AS (SELECT DISTINCT p_name, p_type FROM part WHERE p_size < 45),
m AS (SELECT p.p_name || '|' || p.p_type AS plan_code, CASE WHEN s.p_name IS NULL THEN 'missing' WHEN k IN (0, 3) THEN 'exact' WHEN k = 1 THEN 'signature'
 WHEN p.p_type = 'SMALL' THEN 'ambiguous' ELSE 'unique_without_degree' END AS method FROM p LEFT JOIN s USING (p_name, p_type))"""


@query("d10_match_registry", _REG + " SELECT plan_code, method, method NOT IN ('missing', 'ambiguous') AS found FROM m")
def d10(v):
    return M.match_registry(*registry(v))[0].select("plan_code", "method", c("scraped").isNotNull().alias("found"))


@query("d10_registry_coverage", _REG + """
SELECT count(*) AS expected, count(*) FILTER (WHERE method NOT IN ('missing', 'ambiguous')) AS matched,
 count(*) FILTER (WHERE method NOT IN ('missing', 'ambiguous')) AS catalog, count(*) FILTER (WHERE method = 'missing') AS missing,
 count(*) FILTER (WHERE method = 'ambiguous') AS ambiguous,
 round(count(*) FILTER (WHERE method NOT IN ('missing', 'ambiguous')) / count(*) * 100, 1) AS percent FROM m""")
def d10_coverage(v):
    return M.registry_coverage(M.match_registry(*registry(v))[0])


@query("d10_unexpected", _REG + """
SELECT DISTINCT 'Left over ' || p_type AS scraped FROM part WHERE p_size < 45
UNION ALL SELECT upper(s.p_name[1]) || string_split(s.p_name, ' ')[1][2:] || ' ' || upper(string_split(s.p_name, ' ')[2][1]) || string_split(s.p_name, ' ')[2][2:] || ', SMALL' || x
FROM s, (SELECT unnest([' Major in B.A.', ', B.F.A.']) AS x) WHERE p_type = 'SMALL' AND length(s.p_name) % 4 = 2""")
def d10_unexpected(v):
    return M.match_registry(*registry(v))[1]


def rating_state(v):
    targets, _, _, _, _ = people(v)
    part = v.table("part")
    cached = part.groupBy(c("p_name").alias("name_key")).agg(F.max("p_size").alias("m"), F.bool_or(c("p_retailprice") > 1050).alias("manual")) \
        .filter("m >= 48").select(F.when(c("m") == 48, F.concat(c("name_key"), F.lit(" gone"))).otherwise(c("name_key")).alias("name_key"), "manual")
    return M.ratings_sync(targets.select(c("target_id").alias("name_key")), cached,
                          picks(v).select(c("target_id").alias("name_key"), "outcome"))


_SYNC = _PICK + """,
ca AS (SELECT CASE WHEN m = 48 THEN p_name || ' gone' ELSE p_name END AS name_key, manual FROM
 (SELECT p_name, max(p_size) AS m, bool_or(p_retailprice > 1050) AS manual FROM part GROUP BY 1) WHERE m >= 48),
st AS (SELECT coalesce(pick.target_id, ca.name_key) AS name_key, CASE WHEN pick.target_id IS NULL THEN 'dropped' WHEN manual THEN 'manual_kept'
 WHEN ca.name_key IS NOT NULL AND outcome LIKE 'matched%' THEN 'refreshed' WHEN ca.name_key IS NOT NULL THEN 'kept'
 WHEN outcome LIKE 'matched%' THEN 'new' ELSE 'unmatched' END AS state, outcome FROM pick FULL JOIN ca ON pick.target_id = ca.name_key)"""


@query("e33_ratings_sync", _SYNC + " SELECT name_key, state, CASE WHEN state = 'unmatched' THEN outcome END AS reason FROM st")
def e33(v):
    return rating_state(v)


@query("e33_ratings_sync_summary", _SYNC + """
SELECT state, CASE WHEN state = 'unmatched' THEN outcome END AS reason, count(*) AS n FROM st GROUP BY ALL""")
def e33_summary(v):
    return M.sync_summary(rating_state(v))


def override_tables(v):
    s = v.table("supplier")
    records = s.filter("s_acctbal > 0").select(
        c("s_name").alias("name_key"), c("s_acctbal").alias("metrics_rating"), (c("s_nationkey") < 12).alias("manual"),
        F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"))
    overrides = s.filter("s_nationkey >= 6 AND s_nationkey < 18").select(
        c("s_name").alias("name_key"), c("s_suppkey").cast("double").alias("metrics_rating"), F.lit("2024-02-02").alias("updated_at"))
    return records, overrides


@query("h6_upsert_override", """
SELECT s_name AS name_key, CASE WHEN s_nationkey BETWEEN 6 AND 17 THEN s_suppkey::DOUBLE ELSE s_acctbal END AS metrics_rating,
 s_nationkey < 18 AS manual, CASE WHEN s_nationkey BETWEEN 6 AND 17 AND NOT (s_acctbal > 0 AND s_nationkey < 12) THEN '2024-02-02' ELSE '2024-01-01' END AS created_at,
 CASE WHEN s_nationkey BETWEEN 6 AND 17 THEN '2024-02-02' ELSE '2024-01-01' END AS updated_at
FROM supplier WHERE s_acctbal > 0 OR s_nationkey BETWEEN 6 AND 17""")
def h6(v):
    return M.upsert_override(*override_tables(v))


@query("h6_delete_override", """
SELECT 'record' AS part, s_name AS name_key, '' AS reason FROM supplier WHERE s_acctbal > 0 AND NOT (s_nationkey < 12 AND s_nationkey BETWEEN 6 AND 17)
UNION ALL SELECT 'unmatched', s_name, 'no_name_match' FROM supplier WHERE s_acctbal > 9000
UNION ALL SELECT 'unmatched', s_name, 'manual_override_removed' FROM supplier WHERE s_acctbal > 0 AND s_acctbal <= 9000 AND s_nationkey BETWEEN 6 AND 11""")
def h6_delete(v):
    records, overrides = override_tables(v)
    unmatched = v.table("supplier").filter("s_acctbal > 9000").select(c("s_name").alias("name_key"), F.lit("no_name_match").alias("reason"))
    left, unmatched = M.delete_override(records, unmatched, overrides)
    return left.select(F.lit("record").alias("part"), "name_key", F.lit("").alias("reason")).union(
        unmatched.select(F.lit("unmatched"), "name_key", "reason"))


def event_slots(v, kinds):
    minute = F.hour("ts") * 60 + F.minute("ts")
    none = F.lit(None).cast("date")
    low = c("k") < 20
    return v.updates().filter(c("event_type").isin(*kinds)).select(
        c("user_id").alias("grp"), c("event_id").alias("key"), c("event_id").alias("ord"),
        F.lower(F.date_format("ts", "EEE")).alias("day"), minute.alias("start_min"),
        F.least(minute + c("seats") + 1, F.lit(1440)).alias("end_min"),
        F.when(low, none).otherwise(F.date_sub("ts", 7)).alias("date_from"),
        F.when(low, none).otherwise(F.date_add("ts", 7)).alias("date_to"))


@query("d7_schedule_conflicts", """
WITH e AS (SELECT user_id AS grp, event_id AS key, event_type, strftime(ts, '%a') AS day, hour(ts) * 60 + minute(ts) AS s,
 least(hour(ts) * 60 + minute(ts) + seats + 1, 1440) AS e, CASE WHEN k >= 20 THEN ts::DATE - 7 END AS d0, CASE WHEN k >= 20 THEN ts::DATE + 7 END AS d1 FROM upd)
SELECT c.grp, c.key, min(p.key) AS conflict_with FROM e c JOIN e p ON c.grp = p.grp AND c.day = p.day AND c.s < p.e AND p.s < c.e
 AND coalesce(c.d0 <= p.d1, true) AND coalesce(p.d0 <= c.d1, true)
WHERE p.event_type IN ('purchase', 'signup') AND c.event_type NOT IN ('purchase', 'signup') GROUP BY ALL""")
def d7(v):
    return C.schedule_conflicts(event_slots(v, ["purchase", "signup"]), event_slots(v, ["click", "view", "error"]))


@query("m1_meeting_entries", "SELECT listing_id, (no - 1)::INT AS place, day, s::INT AS start_min, e::INT AS end_min FROM meet WHERE s IS NOT NULL")
def m1(v):
    return C.meeting_entries(v.listings("none"))[0].drop("location")


@query("m1_unscheduled", "SELECT listing_id FROM lst WHERE listing_id NOT IN (SELECT listing_id FROM meet WHERE s IS NOT NULL)")
def m1_rest(v):
    return C.meeting_entries(v.listings("none"))[1]


@query("m2_meeting_recurrence", """
WITH r AS (SELECT listing_id, no, day, s, date_from, date_to, list_position(['sun','mon','tue','wed','thu','fri','sat'], day) - 1 AS dow FROM meet),
f AS (SELECT *, (date_from + ((dow - dayofweek(date_from) + 7) % 7)::INT) AS f FROM r)
SELECT listing_id, (no - 1)::INT AS place, CASE WHEN s IS NOT NULL THEN strftime(f, '%Y-%m-%d') END AS first_date,
 CASE WHEN s IS NOT NULL THEN upper(day[1:2]) END AS by_days, CASE WHEN s IS NULL THEN 0 ELSE ((date_to - f) // 7 + 1)::INT END AS n, s IS NULL AS skipped FROM f""")
def m2(v):
    return C.meeting_recurrence(v.listings("none")).withColumn("first_date", F.date_format("first_date", "yyyy-MM-dd"))


@query("m2_meeting_occurrences", """
WITH r AS (SELECT listing_id, no, day, date_from, date_to, list_position(['sun','mon','tue','wed','thu','fri','sat'], day) - 1 AS dow FROM meet WHERE s IS NOT NULL),
x AS (SELECT listing_id, unnest(generate_series(date_from + ((dow - dayofweek(date_from) + 7) % 7)::INT, date_to, INTERVAL 7 DAY)) AS d FROM r)
SELECT strftime(d, '%Y-%m-%d') AS date, count(*) AS n, count(DISTINCT listing_id) AS listings FROM x GROUP BY 1""")
def m2_dates(v):
    """Occurrences of the whole table, counted per calendar date."""
    return C.occurrences_per_date(v.listings("none")).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "n", "listings")


def adds(v):
    """Events as adds of item k (error removes it); an item has a fixed day and time."""
    from offergrid.functions.parsing import DAYS
    start = (480 + (c("k") * 7 % 60) * 10).cast("int")
    return v.updates().select(c("user_id").alias("grp"), F.get(F.array(*[F.lit(d) for d in DAYS]), (c("k") % 5)).alias("day"),
                              c("event_id").alias("ord"), F.when(c("event_type") == "error", "remove").otherwise("add").alias("action"),
                              c("k").cast("long").alias("item"), start.alias("start_min"), (start + 75).alias("end_min"))


@query("m4_accept_schedule", """
WITH e AS (SELECT user_id AS grp, k % 5 AS d, event_id AS ord, event_type = 'error' AS rm, k AS item, 480 + (k * 7 % 60) * 10 AS s,
 row_number() OVER (PARTITION BY user_id, k % 5 ORDER BY event_id) AS rn FROM upd),
f AS (SELECT grp, d, ord, item, rn, CASE WHEN rm THEN 'not_held' ELSE 'accepted' END AS result, CASE WHEN rm THEN []::INT[] ELSE [item]::INT[] END AS held FROM e WHERE rn = 1
UNION ALL SELECT e.grp, e.d, e.ord, e.item, e.rn, x.result, CASE x.result WHEN 'removed' THEN list_filter(f.held, lambda h: h <> e.item) WHEN 'accepted' THEN list_append(f.held, e.item) ELSE f.held END
FROM f JOIN e ON e.grp = f.grp AND e.d = f.d AND e.rn = f.rn + 1, LATERAL (SELECT CASE WHEN e.rm THEN CASE WHEN list_contains(f.held, e.item) THEN 'removed' ELSE 'not_held' END
 WHEN list_contains(f.held, e.item) THEN 'duplicate' WHEN len(list_filter(f.held, lambda h: abs((h * 7 % 60) * 10 + 480 - e.s) < 75)) > 0 THEN 'conflict' ELSE 'accepted' END AS result) x)
SELECT grp, ['mon','tue','wed','thu','fri'][d + 1] AS day, ord, item, result FROM f""")
def m4(v):
    return C.accept_schedule(adds(v))


_DATED = """
e AS (SELECT user_id AS grp, event_id AS ord, event_type = 'error' AS rm, k AS item, k % 5 AS d1, CASE WHEN event_id % 3 = 0 THEN (k + 2) % 5 END AS d2,
 480 + (k * 7 % 60) * 10 AS s, CASE WHEN event_id % 11 <> 0 THEN 30 * (event_id % 4) END AS f,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM upd),
fold AS (SELECT grp, ord, item, d1, d2, rn, CASE WHEN rm THEN 'not_held' ELSE 'accepted' END AS result,
 CASE WHEN rm THEN [] ELSE [{'i': item, 'a': d1, 'b': d2, 's': s, 'f': f}] END AS held FROM e WHERE rn = 1
UNION ALL SELECT e.grp, e.ord, e.item, e.d1, e.d2, e.rn, x.result, CASE x.result WHEN 'removed' THEN list_filter(fold.held, lambda h: h.i <> e.item)
 WHEN 'accepted' THEN list_append(fold.held, {'i': e.item, 'a': e.d1, 'b': e.d2, 's': e.s, 'f': e.f}) ELSE fold.held END
FROM fold JOIN e ON e.grp = fold.grp AND e.rn = fold.rn + 1, LATERAL (SELECT CASE
 WHEN e.rm THEN CASE WHEN len(list_filter(fold.held, lambda h: h.i = e.item)) > 0 THEN 'removed' ELSE 'not_held' END
 WHEN len(list_filter(fold.held, lambda h: h.i = e.item)) > 0 THEN 'duplicate'
 WHEN len(list_filter(fold.held, lambda h: abs(h.s - e.s) < 75 AND coalesce(abs(h.f - e.f) <= 45, true)
  AND (h.a = e.d1 OR h.a = coalesce(e.d2, -1) OR coalesce(h.b, -2) = e.d1 OR coalesce(h.b, -2) = coalesce(e.d2, -1)))) > 0 THEN 'conflict'
 ELSE 'accepted' END AS result) x)
SELECT grp, ord, item, result, ['mon','tue','wed','thu','fri'][d + 1] AS day FROM (
 SELECT *, d1 AS d FROM fold UNION ALL SELECT *, d2 FROM fold WHERE d2 IS NOT NULL)"""


def dated_adds(updates):
    """Adds of one or two days that run 45 days of the term, or nobody knows when."""
    days = F.array(*[F.lit(d) for d in ("mon", "tue", "wed", "thu", "fri")])
    start = (F.lit(480) + (c("k") * 7 % 60) * 10).cast("int")
    first = F.when(c("event_id") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (30 * (c("event_id") % 4)).cast("int")))
    on = F.when(c("event_id") % 3 == 0, F.array(c("k") % 5, (c("k") + 2) % 5)).otherwise(F.array(c("k") % 5))
    return updates.withColumn("d", F.explode(on)).select(
        c("user_id").alias("grp"), F.get(days, c("d").cast("int")).alias("day"), c("event_id").alias("ord"),
        F.when(c("event_type") == "error", "remove").otherwise("add").alias("action"), c("k").cast("long").alias("item"),
        start.alias("start_min"), (start + 75).alias("end_min"), first.alias("date_from"), F.date_add(first, 45).alias("date_to"))


@query("m4_accept_schedule_dates", f"WITH {_DATED}")
def m4_dates(v):
    return C.accept_schedule(dated_adds(v.updates()))


@query("m4_accept_schedule_stream", f"WITH {_DATED}")
def m4_stream(v):
    """The adds arrive in three slices; accepted meetings wait in the state store."""
    from offergrid.plans.streams import run
    return run(v, lambda s: C.accept_schedule_stream(dated_adds(s))).drop("batch")
