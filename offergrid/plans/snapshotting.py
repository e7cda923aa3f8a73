"""Snapshot diffs, target checks, partial merges (D11-D14, E13-E18, E26, E34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.functions.parsing import mode_of_codes
from offergrid.operators import snapshots as S
from offergrid.operators.options import physical
from offergrid.plans.registry import query

c = F.col

_KEYED = """
WITH ka AS (SELECT *, subject || '|' || coalesce(crse_id, 'catalog:' || number) || '|' || offer || '|' || career AS key,
 subject || '|' || coalesce(crse_id, 'catalog:' || number) AS crse_key, subject || '|' || number || '|' || career AS identity FROM snap_a),
kb AS (SELECT *, subject || '|' || coalesce(crse_id, 'catalog:' || number) || '|' || offer || '|' || career AS key,
 subject || '|' || coalesce(crse_id, 'catalog:' || number) AS crse_key, subject || '|' || number || '|' || career AS identity FROM snap_b),
la AS (SELECT * FROM ka WHERE key NOT IN (SELECT key FROM kb)), lb AS (SELECT * FROM kb WHERE key NOT IN (SELECT key FROM ka)),
mv AS (SELECT la.crse_key, la.key AS key_a, lb.key AS key_b, la.title <> lb.title AS t, la.section_count <> lb.section_count AS n, la.offer <> lb.offer AS o
 FROM la JOIN lb ON la.crse_key = lb.crse_key WHERE la.crse_id IS NOT DISTINCT FROM lb.crse_id
 AND (SELECT count(*) FROM ka k WHERE k.crse_key = la.crse_key) = 1 AND (SELECT count(*) FROM kb k WHERE k.crse_key = la.crse_key) = 1),
rk AS (SELECT la.identity, la.key AS key_a, lb.key AS key_b, concat_ws(',', CASE WHEN la.crse_id IS DISTINCT FROM lb.crse_id THEN 'crse_id' END,
  CASE WHEN la.offer <> lb.offer THEN 'offer' END, 'class_number', CASE WHEN la.section_count <> lb.section_count THEN 'section_count' END) AS changed
 FROM la JOIN lb ON la.identity = lb.identity WHERE lower(la.title) = lower(lb.title) AND la.crse_id IS DISTINCT FROM lb.crse_id
 AND la.key NOT IN (SELECT key_a FROM mv) AND lb.key NOT IN (SELECT key_b FROM mv)),
sm AS (SELECT ka.key, 'same' AS kind, CASE WHEN ka.title <> kb.title THEN 'title' ELSE '' END AS changed, false AS offer_changed
 FROM ka JOIN kb ON ka.key = kb.key UNION ALL SELECT crse_key, 'moved', concat_ws(',', CASE WHEN t THEN 'title' END, CASE WHEN n THEN 'section_count' END), o FROM mv)"""


@query("d11_snapshot_diff", _KEYED + """
SELECT (SELECT count(*) FROM sm) AS matching, (SELECT count(*) FROM sm WHERE changed <> '') AS metadata_changes,
 (SELECT count(*) FROM sm WHERE offer_changed) AS offer_changes, (SELECT count(*) FROM rk) AS rekeyed,
 (SELECT count(*) FROM lb WHERE key NOT IN (SELECT key_b FROM mv) AND key NOT IN (SELECT key_b FROM rk)) AS added,
 (SELECT count(*) FROM la WHERE key NOT IN (SELECT key_a FROM mv) AND key NOT IN (SELECT key_a FROM rk)) AS removed,
 'drift_detected' AS status""")
def d11(v):
    return S.snapshot_diff(*v.snapshots()).summary


@query("d11_matched", _KEYED + " SELECT * FROM sm")
def d11_matched(v):
    return S.snapshot_diff(*v.snapshots()).matched


@query("d11_added_removed", _KEYED + """
SELECT 'added' AS side, key, title FROM lb WHERE key NOT IN (SELECT key_b FROM mv) AND key NOT IN (SELECT key_b FROM rk)
UNION ALL SELECT 'removed', key, title FROM la WHERE key NOT IN (SELECT key_a FROM mv) AND key NOT IN (SELECT key_a FROM rk)""")
def d11_sides(v):
    d = S.snapshot_diff(*v.snapshots())
    return d.added.select(F.lit("added").alias("side"), "key", "title").union(
        d.removed.select(F.lit("removed"), "key", "title"))


@query("d12_reconcile_moves", _KEYED + " SELECT crse_key, key_a, key_b FROM mv")
def d12(v):
    before, after = v.snapshots()
    all_a, all_b = S.with_keys(before), S.with_keys(after)
    a, b = S._struct(S.preferred(all_a), "a"), S._struct(S.preferred(all_b), "b")
    return S.reconcile_moves(a.join(b, "key", "left_anti"), b.join(a, "key", "left_anti"), all_a, all_b).select(
        "crse_key", "key_a", "key_b")


@query("d13_detect_rekeys", _KEYED + " SELECT * FROM rk")
def d13(v):
    return S.snapshot_diff(*v.snapshots()).rekeyed


def order_details(v):
    """One detail per order that has lines; its state follows from the lines."""
    return v.table("lineitem").groupBy(c("l_orderkey").alias("key")).agg(
        F.when(F.max("l_tax") < 0.02, "partial").otherwise("complete").alias("status"),
        (F.count_if(c("l_returnflag") == "N") > 0).alias("has_info"), (F.min("l_linenumber") == 1).alias("grid_complete"),
        F.count_if(c("l_linestatus") == "F").alias("n_rows"))


@query("d14_check_targets", """
WITH d AS (SELECT l_orderkey AS key, max(l_tax) < 0.02 AS part, count(*) FILTER (WHERE l_returnflag = 'N') > 0 AS info,
 min(l_linenumber) = 1 AS grid, count(*) FILTER (WHERE l_linestatus = 'F') AS n FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT o_orderkey AS key, CASE WHEN d.key IS NULL THEN 'course_detail_missing' WHEN part THEN 'course_detail_not_complete'
 WHEN NOT info THEN 'course_info_missing' WHEN NOT grid THEN 'course_option_grid_incomplete' WHEN n = 0 THEN 'course_sections_missing' END AS code
FROM orders LEFT JOIN d ON o_orderkey = d.key) WHERE code IS NOT NULL""")
def d14(v):
    return S.check_targets(v.table("orders").select(c("o_orderkey").alias("key")), order_details(v), "key")


def key_lists(v):
    expected = v.table("orders").select(c("o_custkey").alias("by"), c("o_orderkey").alias("place"),
                                        c("o_orderkey").alias("key"))
    stored = expected.join(v.table("lineitem").select(c("l_orderkey").alias("key")).distinct(), "key")
    return S.same_key_list(expected, stored, "key", "place", "by")


@query("d14_key_lists", """
SELECT o_custkey AS by, bool_and(o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS same FROM orders GROUP BY 1""")
def d14_lists(v):
    return key_lists(v)


def conv_parts(v):
    user = c("role") == "user"
    return v.table("conversations").select(
        "conv_id", "turn", F.when(~user, F.substring_index("text", " ", 1)).alias("first_word"),
        F.when(F.length("text") > 300, F.length("text")).alias("long_size"),
        F.when(user & (c("turn") > 0), c("turn")).alias("later_turn"),
        F.when(F.length("text") > 600, "closed").when(F.length("text") > 150, "open").otherwise("unknown").alias("status"),
        "text")


@query("e13_merge_partials", """
SELECT conv_id, arg_min(string_split(text, ' ')[1], turn) FILTER (WHERE role <> 'user') AS first_word,
 (arg_min(length(text), turn) FILTER (WHERE length(text) > 300))::INT AS long_size, min(turn) FILTER (WHERE role = 'user' AND turn > 0) AS later_turn,
 coalesce(arg_min(CASE WHEN length(text) > 600 THEN 'closed' ELSE 'open' END, turn) FILTER (WHERE length(text) > 150), 'unknown') AS status,
 count(*) AS parts FROM conversations GROUP BY conv_id""")
def e13(v):
    return S.merge_partials(conv_parts(v), "conv_id", "turn", ["first_word", "long_size", "later_turn"], "status")


@query("e13_merge_lists", """
WITH x AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS item, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations)
SELECT conv_id, item, min(struct_pack(turn, i)).turn AS first_part, min(struct_pack(turn, i)).i::INT AS first_place FROM x GROUP BY ALL""")
def e13_lists(v):
    return S.merge_lists(conv_parts(v), "conv_id", "turn", F.split("text", "\n"))


@query("e14_assemble_listings", """
SELECT listing_id AS class_number, l_partkey::VARCHAR AS course_key, l.course_code, l.title,
 CASE WHEN l_linenumber % 2 = 1 THEN section_number ELSE 'o' || section_number END AS section_number,
 component, CASE WHEN l_linenumber <> 3 THEN seats_available ELSE 99 END AS open_seats, seat_capacity AS capacity, location,
 CASE WHEN seat_status = 'waitlist' THEN 'open' ELSE seat_status END AS status,
 coalesce(units_min, p_size % 4) AS units_min, coalesce(units_max, p_size % 4 + 9) AS units_max, grading,
 CASE WHEN l_linenumber = 7 THEN 1 WHEN l_linenumber = 2 THEN 2 ELSE 1 END::INT AS n_meetings,
 CASE WHEN l_linenumber = 7 THEN 'opt' WHEN l_linenumber = 5 THEN 'opt2' ELSE instructor END AS instructor
FROM lst l""")
def e14(v):
    lst, line = v.listings(), c("l_linenumber")
    part = v.table("part")
    courses = part.select(c("p_partkey").cast("string").alias("course_key"), c("p_name").alias("title"),
                          (c("p_size") % 4).cast("double").alias("units_min"),
                          (c("p_size") % 4 + 9).cast("double").alias("units_max"), F.lit("other").alias("grading"))
    who = F.when(line != 5, F.coalesce("instructor", F.lit("")))
    met = F.transform("meetings", lambda m: F.struct(m["start_min"].alias("start_min"), m["end_min"].alias("end_min"),
                                                     who.alias("instructor")))
    classes = lst.select(
        c("listing_id").alias("class_number"), F.when(line % 2 == 1, c("section_number")).alias("section_number"),
        F.when(line != 1, c("component")).alias("component"),
        F.when(c("seat_status") == "waitlist", "unknown").otherwise(c("seat_status")).alias("status"),
        F.when(line != 3, c("seats_available")).alias("open_seats"), c("seat_capacity").alias("capacity"), "location",
        "units_min", "units_max", "grading", met.alias("meetings"))
    hint = F.when(line == 7, "opt").when(line == 5, "opt2").otherwise(c("instructor"))
    options = lst.select(
        c("listing_id").alias("class_number"), c("l_partkey").cast("string").alias("course_key"), "course_code",
        F.concat(F.lit("o"), c("section_number")).alias("section_number"), "component", F.lit("open").alias("status"),
        F.when(line != 3, c("seats_available")).otherwise(99).alias("open_seats"), c("seat_capacity").alias("capacity"),
        "location", hint.alias("instructor"),
        F.struct(F.lit(540).cast("int").alias("start_min"), F.lit(600).cast("int").alias("end_min"),
                 hint.alias("instructor")).alias("meeting"))
    codes = lst.select(c("listing_id").alias("class_number"), "course_code")
    courses = courses.withColumn("course_code", F.lit(None).cast("string"))
    out = S.assemble_listings(courses, options, classes).drop("course_code").join(codes, "class_number")
    return out.withColumn("n_meetings", F.size("meetings")).drop("meetings")


def export_rows(v):
    """Lines as export rows; one class number is an order and a line number."""
    line = c("l_linenumber")
    lst = v.listings("part", "supplier")
    m = F.get("meetings", F.lit(0))
    return lst.select(
        F.concat_ws("-", c("l_orderkey").cast("string"), line.cast("string")).alias("class_number"), "listing_id",
        "subject", "catalog_number", "title", "units", c("seat_capacity").alias("capacity"),
        F.when(c("l_discount") > 0.05, F.lit(3)).cast("int").alias("enrolled"),
        F.when(c("l_tax") > 0.04, "O").alias("status"),
        F.when(c("l_returnflag") == "N", "P").when(c("l_returnflag") == "A", "ON").otherwise("HY").alias("mode"),
        F.get(m["days"], F.lit(0)).alias("day"), m["start_min"].alias("start_min"), m["end_min"].alias("end_min"),
        m["location"].alias("room"), "instructor")


_EXPORT = """
WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS class_number, l.*, CASE WHEN l_discount > 0.05 THEN 3 END AS enrolled,
 CASE WHEN l_tax > 0.04 THEN 'O' END AS st, CASE l_returnflag WHEN 'N' THEN 'P' WHEN 'A' THEN 'ON' ELSE 'HY' END AS mode FROM lst l)"""


@query("e15_fold_csv_rows", _EXPORT + """
SELECT class_number, arg_min(subject, listing_id) AS subject, arg_min(catalog_number, listing_id) AS catalog_number,
 arg_min(title, listing_id) AS title, arg_min(units, listing_id) AS units, arg_min(seat_capacity, listing_id) AS capacity,
 arg_min(enrolled, listing_id) FILTER (WHERE enrolled IS NOT NULL) AS enrolled, arg_min(st, listing_id) FILTER (WHERE st IS NOT NULL) AS status,
 CASE WHEN bool_or(mode = 'HY') OR count(DISTINCT mode) = 2 THEN 'hybrid' WHEN bool_or(mode = 'P') THEN 'in_person'
  WHEN min(l_linenumber) < 6 THEN 'online_synchronous' ELSE 'online_asynchronous' END AS mode, count(*) AS n_rows FROM x GROUP BY 1""")
def e15(v):
    heads, _, _ = S.fold_export_rows(export_rows(v), "class_number", "listing_id")
    return heads.withColumn("mode", mode_of_codes(c("modes"), c("timed"))).drop("modes", "timed")


@query("e15_folded_parts", _EXPORT + """
SELECT class_number, 'meeting' AS kind, concat_ws(' ', lower(strftime(l_shipdate, '%a')), CASE WHEN l_linenumber <> 6 THEN 480 + 30 * (l_partkey % 20) END,
 CASE WHEN l_linenumber <> 6 THEN 480 + 30 * (l_partkey % 20) + 50 + 25 * (l_suppkey % 4) END, location) AS value, min(listing_id) AS first_row
FROM x WHERE l_linenumber <> 7 GROUP BY ALL
UNION ALL SELECT class_number, 'instructor', instructor, min(listing_id) FROM x WHERE instructor IS NOT NULL GROUP BY ALL""")
def e15_parts(v):
    return S.fold_export_rows(export_rows(v), "class_number", "listing_id")[1]


@query("e15_conflicts", _EXPORT + """
SELECT class_number, count(DISTINCT subject || ' ' || catalog_number) AS courses FROM x GROUP BY 1 HAVING courses > 1""")
def e15_conflicts(v):
    return S.fold_export_rows(export_rows(v), "class_number", "listing_id")[2]


@query("e16_collapse_duplicate_offers", """
WITH s AS (SELECT doc_id, lang, n_chars, list_sort(list_distinct(string_split_regex(text, '\\s+')))::VARCHAR AS words,
 len(list_distinct(string_split_regex(text, '\\s+'))) AS n FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY lang, words ORDER BY n_chars DESC, doc_id) AS kept FROM s)
SELECT doc_id AS detail_key, kept, n AS classes FROM r WHERE doc_id <> kept""")
def e16(v):
    """Documents as offers of their language, their distinct words as class numbers."""
    docs = v.table("documents")
    details = docs.select(c("doc_id").alias("detail_key"), c("lang").alias("identity"),
                          c("doc_id").cast("string").alias("offer"), c("n_chars").alias("score"))
    rows = docs.select(c("doc_id").alias("detail_key"), F.explode(F.split("text", r"\s+")).alias("class_number"))
    return S.collapse_duplicate_offers(details, rows)


@query("e17_fill_if_agreed", """
WITH g AS (SELECT physical, min(description) AS v FROM lst GROUP BY 1 HAVING count(DISTINCT description) = 1)
SELECT listing_id, coalesce(description, g.v) AS description, description IS NULL AND g.v IS NOT NULL AS filled
FROM lst l LEFT JOIN g ON l.physical = g.physical""")
def e17(v):
    return S.fill_if_agreed(physical(v.listings("order", "part")), ["physical"], "description").select(
        "listing_id", "description", "filled")


@query("e18_merge_hits", """
WITH u AS (SELECT l_orderkey || '|' || l_partkey AS hit_key, l_linenumber AS n, '1' || listing_id AS seq, title, false AS capped FROM lst WHERE l_quantity <= 30
UNION ALL SELECT l_orderkey || '|' || l_partkey, CASE WHEN l_tax > 0.01 THEN l_quantity::INT % 7 END, '2' || listing_id, title || '*', l_tax > 0.07 FROM lst WHERE l_quantity >= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY hit_key ORDER BY coalesce(n, -1) DESC, seq) AS rn, bool_or(capped) OVER (PARTITION BY hit_key) AS cap FROM u)
SELECT hit_key, n AS section_count, seq, title, NOT cap AS complete FROM r WHERE rn = 1""")
def e18(v):
    lst = v.listings("part").withColumn("hit_key", F.concat_ws("|", c("l_orderkey").cast("string"),
                                                               c("l_partkey").cast("string")))
    one = lst.filter("l_quantity <= 30").select(
        "hit_key", c("l_linenumber").alias("section_count"), F.concat(F.lit("1"), c("listing_id")).alias("seq"), "title",
        F.lit(False).alias("capped"))
    two = lst.filter("l_quantity >= 20").select(
        "hit_key", F.when(c("l_tax") > 0.01, c("seat_capacity") % 7), F.concat(F.lit("2"), c("listing_id")),
        F.concat(c("title"), F.lit("*")), c("l_tax") > 0.07)
    return S.merge_hits(one.union(two), "hit_key", "section_count", "seq")


@query("e26_run_progress", """
WITH d AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS ok, count(*) FILTER (WHERE l_returnflag = 'R') AS w, sum(l_quantity) > 320 AS bad FROM lineitem GROUP BY 1),
p AS (SELECT c_nationkey AS subject, count(*) AS targeted, count(d.l_orderkey) AS attempted, count(*) FILTER (WHERE ok) AS complete,
 count(*) FILTER (WHERE NOT ok) AS partial, coalesce(sum(w), 0)::BIGINT AS warnings, coalesce(bool_or(bad), false) AS bad
 FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN d ON o_orderkey = l_orderkey GROUP BY 1)
SELECT subject, targeted, attempted, complete, partial, warnings, CASE WHEN attempted = 0 THEN 'pending' WHEN complete = targeted AND NOT bad THEN 'complete'
 WHEN bad THEN 'failed' ELSE 'partial' END AS status FROM p""")
def e26(v):
    targets = v.table("orders").join(v.table("customer"), c("o_custkey") == c("c_custkey")).select(
        c("c_nationkey").alias("subject"), c("o_orderkey").alias("key"))
    details = v.table("lineitem").groupBy(c("l_orderkey").alias("key")).agg(
        F.when(F.bool_and(c("l_linestatus") == "F"), "complete").otherwise("partial").alias("status"),
        F.count_if(c("l_returnflag") == "R").alias("warnings"), (F.sum("l_quantity") > 320).alias("failed"))
    return S.run_progress(targets, details, "subject", "key")


@query("e34_resume_plan", """
WITH t AS (SELECT o_orderkey AS key, o_orderkey AS place, o_custkey FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT l_orderkey AS key, count(*) >= 2 AS ok, min(l_linenumber) AS attempts FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1),
inv AS (SELECT o_custkey, bool_and(o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS same FROM orders GROUP BY 1)
SELECT t.key, t.place, CASE WHEN ok AND same THEN 'keep' ELSE 'todo' END AS action,
 coalesce(attempts, 0) + CASE WHEN ok AND same THEN 0 ELSE 1 END AS attempts
FROM t LEFT JOIN p ON t.key = p.key JOIN inv ON t.o_custkey = inv.o_custkey
UNION ALL SELECT key, NULL, 'drop', attempts FROM p WHERE key NOT IN (SELECT key FROM t)""")
def e34(v):
    targets = v.table("orders").filter("o_orderstatus <> 'P'").select(
        c("o_orderkey").alias("key"), c("o_orderkey").alias("place"), c("o_custkey").alias("by"))
    prior = v.table("lineitem").filter("l_shipdate < '1999-01-01'").groupBy(c("l_orderkey").alias("key")).agg(
        F.when(F.count(F.lit(1)) >= 2, "complete").otherwise("partial").alias("status"),
        F.min("l_linenumber").alias("attempts"))
    return S.resume_plan(targets, prior, "key", key_lists(v))
