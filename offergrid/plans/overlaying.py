"""Group D overlays, H5 and M3."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.operators import overlays as O
from offergrid.operators.options import GROUPED, component_rank, option_members, physical
from offergrid.operators.seats import seat_rules
from offergrid.plans.registry import query
from offergrid.session import settled

c = F.col


@query("d1_overlay_tags", """
WITH own AS (SELECT listing_id, course_code, tag FROM reqtag JOIN lst USING (listing_id)
  WHERE tag IN ('GWAR', 'American Institutions', 'Ethnic Studies', 'Cultural Diversity')),
every AS (SELECT listing_id, tag FROM own UNION SELECT listing_id, label FROM lst JOIN prog USING (course_code) WHERE label IS NOT NULL),
pt AS (SELECT listing_id, program || '/' || year || '/' || classification AS t FROM progtag
  UNION SELECT listing_id, program || '/' || year || '/' || prog.classification FROM lst JOIN prog USING (course_code)),
r AS (SELECT listing_id, string_agg(tag, ',' ORDER BY list_position(['GWAR','American Institutions','Ethnic Studies',
  'Cultural Diversity','3A Arts','3B Humanities','5A Physical Science','5B Biological Science'], tag)) AS labels FROM every GROUP BY 1),
p AS (SELECT listing_id, string_agg(t, ',' ORDER BY t) AS programs FROM pt GROUP BY 1)
SELECT listing_id, coalesce(labels, '') AS labels, programs FROM lst LEFT JOIN r USING (listing_id) LEFT JOIN p USING (listing_id)""")
def d1(v):
    prog = v.programs()
    out = O.overlay_tags(v.listings("part"), prog, prog)
    tags = F.transform("program_tags", lambda t: F.concat_ws("/", t["program"], t["year"], t["classification"]))
    return out.select("listing_id", F.array_join("requirement_tags", ",").alias("labels"),
                      F.array_join(F.array_sort(tags), ",").alias("programs"))


_RATED = """
WITH r AS (SELECT s_suppkey, round(1 + (abs(s_acctbal)::INT % 41) / 10, 1) AS rating, round(1 + (s_nationkey % 9) / 2, 1) AS difficulty,
 (s_suppkey * 7 % 101)::DOUBLE AS again, s_nationkey AS reviews FROM supplier WHERE s_acctbal > 0),
j AS (SELECT l.listing_id, r.s_suppkey IS NOT NULL AS hit, coalesce(r.rating, l.rating) AS rating,
 CASE WHEN r.s_suppkey IS NOT NULL THEN r.reviews ELSE l.reviews END AS reviews
 FROM lst l LEFT JOIN r ON l.l_suppkey = r.s_suppkey AND l.instructor LIKE 'Supplier%')"""


def ratings(v):
    """Ratings by name, written “Last, First”."""
    key = c("s_suppkey")
    words = F.split("s_name", "#")
    metrics = F.struct(
        F.round(1 + (F.rint(F.abs("s_acctbal")).cast("int") % 41) / 10, 1).alias("rating"),
        F.round(1 + (c("s_nationkey") % 9) / 2, 1).alias("difficulty"),
        (key * 7 % 101).cast("double").alias("again"), c("s_nationkey").alias("reviews"),
        F.lit(None).cast("boolean").alias("attendance"), F.lit(None).cast("boolean").alias("textbook"))
    return v.table("supplier").filter("s_acctbal > 0").select(
        F.concat(F.get(words, F.lit(1)), F.lit(", "), F.get(words, F.lit(0))).alias("name"),
        metrics.alias("metrics"))


@query("d2_overlay_metrics", _RATED + " SELECT listing_id, rating, reviews, hit AS changed FROM j")
def d2(v):
    out = O.overlay_metrics(v.listings("supplier"), ratings(v))
    return out.select("listing_id", c("metrics.rating").alias("rating"), c("metrics.reviews").alias("reviews"),
                      "changed")


@query("d3_overlay_instructors", """
SELECT listing_id, CASE WHEN up THEN person ELSE instructor END AS instructor, up AS changed,
 has_metrics AND NOT up AS has_metrics
FROM (SELECT l.*, n.person, coalesce(coalesce(l.instructor, 'To Be Announced') = 'To Be Announced' AND n.person <> 'Staff', false) AS up
 FROM lst l LEFT JOIN names n ON l.physical = n.physical)""")
def d3(v):
    cache = O.newest(v.names(), "physical", ["ts", "event_id"])
    out = O.overlay_instructors(physical(v.listings("order", "supplier")), cache)
    return out.select("listing_id", "instructor", "changed", c("metrics").isNotNull().alias("has_metrics"))


def seat_updates(v):
    rows = O.newest(seat_rules(v.observations()), "physical", ["ts", "event_id"])
    return rows.select("physical", c("status").alias("seat_status"), c("open_seats").alias("seats_available"),
                       c("capacity").alias("seat_capacity"))


_SEATED = """
WITH j AS (SELECT l.listing_id, l.physical, l.seat_status AS old_status, n.physical IS NOT NULL AS hit,
 CASE WHEN n.physical IS NOT NULL THEN n.status ELSE l.seat_status END AS seat_status,
 CASE WHEN n.physical IS NOT NULL THEN n.open_seats ELSE l.seats_available END AS seats_available,
 CASE WHEN n.physical IS NOT NULL THEN n.capacity ELSE l.seat_capacity END AS seat_capacity,
 l.seats_available AS oa, l.seat_capacity AS oc FROM lst l LEFT JOIN newest n ON l.physical = n.physical),
d AS (SELECT *, hit AND (seat_status IS DISTINCT FROM old_status OR seats_available IS DISTINCT FROM oa
 OR seat_capacity IS DISTINCT FROM oc) AS changed FROM j)"""


@query("d4_overlay_seats", _SEATED + """
SELECT listing_id, old_status, seat_status, seats_available, seat_capacity, changed FROM d""")
def d4(v):
    out = O.overlay_seats(physical(v.listings("order")), seat_updates(v))
    return out.select("listing_id", "old_status", "seat_status", "seats_available", "seat_capacity", "changed")


@query("d4_status_changes", _SEATED + """
SELECT old_status, seat_status, count(*) AS listings, count(DISTINCT physical) AS classes FROM d WHERE changed GROUP BY ALL""")
def d4_changes(v):
    return O.status_changes(O.overlay_seats(physical(v.listings("order")), seat_updates(v)))


def hidden_records(v):
    """Every class the flagged documents name, as it stood; some records miss an id.

    A record is made for the classes of suppliers named by a toxic document and
    open listings; where the class has a listing of a GRAD course, that listing
    is missing from the record.
    """
    flagged = v.table("labels").filter("toxic = 1").select(c("doc_id").alias("l_suppkey")).distinct()
    lst = physical(v.listings("order", "part"))
    named = lst.filter("seat_status = 'open'").join(flagged, "l_suppkey", "left_semi").select("physical").distinct()
    rows = lst.join(named, "physical", "left_semi").filter("career = 'UGRD'")
    first = rows.groupBy("physical").agg(F.min_by(F.struct("course_code", "crse_id"), "listing_id").alias("w"))
    return rows.join(first, "physical").select("physical", "listing_id", c("w.course_code").alias("course_code"),
                                               c("w.crse_id").alias("crse_id"))


_HIDDEN = """
WITH flagged AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
named AS (SELECT DISTINCT physical FROM lst WHERE seat_status = 'open' AND l_suppkey IN (SELECT doc_id FROM flagged)),
rec AS (SELECT physical, listing_id, first_value(course_code) OVER w AS course_code, first_value(coalesce(crse_id, '')) OVER w AS crse_id
 FROM lst WHERE career = 'UGRD' AND physical IN (SELECT physical FROM named) WINDOW w AS (PARTITION BY physical ORDER BY listing_id)),
heads AS (SELECT physical, min(course_code) AS course_code, min(crse_id) AS crse_id, string_agg(listing_id, '+' ORDER BY listing_id) AS ids FROM rec GROUP BY 1),
act AS (SELECT physical, string_agg(listing_id, '+' ORDER BY listing_id) AS ids, min(course_code) lo, max(course_code) hi,
 min(coalesce(crse_id, '')) lo2, max(coalesce(crse_id, '')) hi2 FROM lst GROUP BY 1),
rep AS (SELECT h.physical, h.course_code, h.crse_id, h.ids = a.ids AS same_ids,
 h.ids = a.ids AND lo = h.course_code AND hi = h.course_code AND lo2 = h.crse_id AND hi2 = h.crse_id AS applied
 FROM heads h JOIN act a ON h.physical = a.physical)"""


@query("d5_hidden_report", _HIDDEN + " SELECT physical, course_code, crse_id, same_ids, applied FROM rep")
def d5_report(v):
    return O.hidden_report(physical(v.listings("order", "part")), hidden_records(v))


@query("d5_hide_overlay", _HIDDEN + """
SELECT listing_id FROM lst l WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.same_ids AND r.physical = l.physical
 AND r.course_code = l.course_code AND r.crse_id = coalesce(l.crse_id, ''))""")
def d5(v):
    return O.hide_overlay(physical(v.listings("order", "part")), hidden_records(v)).select("listing_id")


_LOOKUP = """
WITH s AS (SELECT upper(course_code) AS code, arg_min(title, listing_id) AS title FROM lst GROUP BY 1),
k AS (SELECT coalesce(s.code, m.code) AS code, coalesce(title, '') AS title, s.code IS NOT NULL AS scheduled
 FROM s FULL JOIN (SELECT DISTINCT upper(course_code) AS code FROM prog) m ON s.code = m.code)"""


@query("d16_code_lookup", _LOOKUP + " SELECT * FROM k")
def d16(v):
    return O.code_lookup(v.listings("part"), v.programs())


@query("d17_suggest", _LOOKUP + """,
q AS (SELECT DISTINCT p_name AS q FROM part UNION SELECT DISTINCT upper(string_split(p_name, ' ')[2]) FROM part
 UNION SELECT DISTINCT p_brand || ' 1' FROM part UNION SELECT DISTINCT substr(p_name, 2, 2) FROM part),
sc AS (SELECT q, code, title, CASE WHEN starts_with(lower(code), lower(q)) THEN 0 WHEN starts_with(lower(title), lower(q)) THEN 1
 WHEN contains(lower(code), lower(q)) THEN 2 WHEN contains(lower(title), lower(q)) THEN 3 END AS score FROM q, k
 WHERE code NOT IN (SELECT upper(course_code) FROM prog WHERE classification = 'elective'))
SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, code) AS rank FROM sc WHERE score IS NOT NULL QUALIFY rank <= 8""")
def d17(v):
    part = v.table("part")
    asks = part.select(c("p_name").alias("q")).union(part.select(F.upper(F.element_at(F.split("p_name", " "), 2)))) \
        .union(part.select(F.concat("p_brand", F.lit(" 1")))).union(part.select(F.substring("p_name", 2, 2)))
    lookup = O.code_lookup(v.listings("part"), v.programs()).select("code", "title")
    taken = v.programs().filter("classification = 'elective'").select("course_code")
    return O.suggest(asks, lookup, excluded=taken).select("q", "code", "title", "score", "rank")


@query("d18_merge_fresh_urls", """
WITH o AS (SELECT *, 'https://old.example.edu/' || number AS detail_url,
  CASE WHEN crse_id IS NOT NULL THEN 'id|' || crse_id || '|' || offer || '|' || career
   ELSE 'code|' || subject || '|' || number || '|' || subject || ' ' || number END AS hit_key FROM snap_a),
f AS (SELECT *, (section_count + 3) % 7 AS fresh_count,
  CASE WHEN crse_id IS NOT NULL THEN 'id|' || crse_id || '|' || offer || '|' || career
   ELSE 'code|' || subject || '|' || number || '|' || subject || ' ' || number END AS hit_key FROM snap_b)
SELECT o.hit_key, f.hit_key IS NOT NULL AS refreshed, greatest(o.section_count, f.fresh_count)::INT AS section_count,
 coalesce(f.title, o.title) AS title, coalesce(f.class_number, o.class_number) AS class_number,
 CASE WHEN o.crse_id IS NULL THEN CASE WHEN f.hit_key IS NULL THEN o.detail_url ELSE 'https://new.example.edu/' || f.number END
  ELSE 'https://classes.example.edu/detail?CRSE_ID=' || o.crse_id || '&CRSE_OFFER_NBR=' || o.offer
   || '&ACAD_CAREER=' || o.career || '&CLASS_NBR=' || coalesce(f.class_number, o.class_number) END AS detail_url
FROM o LEFT JOIN f ON o.hit_key = f.hit_key""")
def d18(v):
    a, b = v.snapshots()
    a = a.withColumn("detail_url", F.concat(F.lit("https://old.example.edu/"), c("number")))
    b = b.withColumn("detail_url", F.concat(F.lit("https://new.example.edu/"), c("number"))) \
        .withColumn("section_count", ((c("section_count") + 3) % 7).cast("int"))
    return O.merge_fresh_urls(a, b, "https://classes.example.edu/detail").select(
        "hit_key", "refreshed", "section_count", "title", "class_number", "detail_url")


@query("h5_prune_counts", """
SELECT 'seats' AS part, count(*) AS before, count(*) FILTER (WHERE physical IN (SELECT physical FROM lst)) AS after FROM newest
UNION ALL SELECT 'sources', count(*), count(*) FILTER (WHERE u IN (SELECT l_suppkey FROM lst)) FROM (SELECT DISTINCT user_id AS u FROM upd)""")
def h5_counts(v):
    lst = physical(v.listings("order"))
    cache = O.newest(seat_rules(v.observations()), "physical", ["ts", "event_id"]).select("physical", "status")
    pages = v.updates().select(F.concat(F.lit("https://classes.example.edu/s/"), c("user_id").cast("string")).alias("source_url")).distinct()
    return O.prune_overlays({"seats": (cache, "physical"), "sources": (pages, "source_url")}, lst)[1]


@query("h5_prune_overlay", """
SELECT 'kept' AS part, physical, status FROM newest WHERE physical IN (SELECT physical FROM lst)
UNION ALL SELECT 'before', count(*)::VARCHAR, '' FROM newest
UNION ALL SELECT 'after', count(*)::VARCHAR, '' FROM newest WHERE physical IN (SELECT physical FROM lst)
UNION ALL SELECT 'source', 'https://classes.example.edu/s/' || u, '' FROM (SELECT DISTINCT user_id AS u FROM upd)
 WHERE u IN (SELECT l_suppkey FROM lst)""")
def h5(v):
    lst = physical(v.listings("order"))
    cache = O.newest(seat_rules(v.observations()), "physical", ["ts", "event_id"]).select("physical", "status")
    kept = O.prune_overlay(cache, lst, "physical")
    pages = v.updates().select(F.concat(F.lit("https://classes.example.edu/s/"), c("user_id").cast("string"))
                               .alias("source_url")).distinct()
    sources = O.prune_overlay(pages, lst, "source_url")

    def count(df, name):
        return df.agg(F.count(F.lit(1)).cast("string").alias("physical")).select(
            F.lit(name).alias("part"), "physical", F.lit("").alias("status"))

    return (kept.select(F.lit("kept").alias("part"), "physical", "status").union(count(cache, "before"))
            .union(count(kept, "after")).union(sources.select(F.lit("source"), "source_url", F.lit(""))))


@query("m3_saved_items_refresh", """
WITH saved AS (SELECT o_custkey AS customer, term || '::' || course_code || '::' || schedule_number AS saved_key, physical,
  seat_status, seats_available, listing_id FROM lst),
hid AS (SELECT physical FROM lst GROUP BY 1 HAVING max(l_tax) >= 0.08 AND bool_and(seat_status = 'closed'))
SELECT customer, saved_key, listing_id, coalesce(n.status, s.seat_status) AS seat_status,
 coalesce(n.open_seats, s.seats_available) AS seats_available, n.physical IS NOT NULL AS refreshed
FROM saved s LEFT JOIN newest n ON s.physical = n.physical WHERE s.physical NOT IN (SELECT physical FROM hid)""")
def m3(v):
    lst = physical(v.listings("order", "part"))
    saved = lst.select(c("o_custkey").alias("customer"), F.concat_ws("::", "term", "course_code", "schedule_number")
                       .alias("saved_key"), "physical", "seat_status", "seats_available", "listing_id")
    gone = lst.groupBy("physical").agg(F.max("l_tax").alias("t"), F.bool_and(c("seat_status") == "closed").alias("x")) \
        .filter("t >= 0.08 AND x").select("physical")
    seats = O.newest(seat_rules(v.observations()), "physical", ["ts", "event_id"])
    return O.saved_items_refresh(saved, seats, gone).drop("physical")


@query("m3_saved_options", """
WITH saved AS (SELECT option_id, any_value(hash_) AS customer FROM (SELECT option_id, n_members AS hash_ FROM opt WHERE n_members > 1) GROUP BY 1),
mb AS (SELECT r.key AS option_id, r.rn, r.listing_id, r.term, r.course_code, r.schedule_number, l.physical, l.seat_status, l.seats_available
 FROM ranked_members r JOIN saved s ON s.option_id = r.key JOIN lst l ON l.listing_id = r.listing_id),
k AS (SELECT option_id, arg_min(term, rn) || '::' || arg_min(upper(course_code), rn) || '::' || string_agg(DISTINCT schedule_number, '+' ORDER BY schedule_number) AS saved_key
 FROM mb GROUP BY 1),
hid AS (SELECT physical FROM lst GROUP BY 1 HAVING max(l_tax) >= 0.08 AND bool_and(seat_status = 'closed')),
gone AS (SELECT DISTINCT option_id FROM mb JOIN hid ON hid.physical = mb.physical)
SELECT mb.option_id, customer, saved_key, listing_id, coalesce(n.status, mb.seat_status) AS seat_status,
 coalesce(n.open_seats, mb.seats_available) AS seats_available, n.physical IS NOT NULL AS refreshed
FROM mb JOIN k ON k.option_id = mb.option_id JOIN saved s ON s.option_id = mb.option_id LEFT JOIN gone g ON g.option_id = mb.option_id
LEFT JOIN newest n ON n.physical = mb.physical WHERE g.option_id IS NULL""")
def m3_options(v):
    """Every option of several classes is saved; their keys name all classes."""
    lst = settled(physical(v.listings("order", "part")).select(*GROUPED, "physical", "seat_status", "seats_available", "l_tax"))
    rows = option_members(lst, ["component", "section_number", "schedule_number", "term", "course_code", "seat_status", "seats_available"])
    members = settled(rows.filter("option_id IS NOT NULL AND n_members > 1").select(
        "option_id", "n_members", F.struct(~c("is_primary"), component_rank(c("component")).alias("component_rank"), "section_number", "schedule_number",
                                           "listing_id").alias("rank"),
        "listing_id", "term", "course_code", "schedule_number", "physical", "seat_status", "seats_available"))
    saved = members.groupBy("option_id").agg(F.max("n_members").alias("customer"))
    members = members.drop("n_members")
    gone = lst.groupBy("physical").agg(F.max("l_tax").alias("t"), F.bool_and(c("seat_status") == "closed").alias("x")) \
        .filter("t >= 0.08 AND x").select("physical")
    seats = O.newest(seat_rules(v.observations()), "physical", ["ts", "event_id"])
    return O.saved_options_refresh(saved, members, seats, gone).select(
        "option_id", "customer", "saved_key", "listing_id", "seat_status", "seats_available", "refreshed")
