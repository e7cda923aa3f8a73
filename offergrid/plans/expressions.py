"""Group B: expressions over whole tables.

Where an expression reads text, the text is rendered from typed columns, so the
oracle can state the expected value from those columns alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.functions import keys as K
from offergrid.functions import labels as L
from offergrid.functions import parsing as P
from offergrid.functions import text as T
from offergrid.operators.ordering import ranked
from offergrid.operators.standardize import Rule, split_subject, standardize
from offergrid.plans.bindings import term_of
from offergrid.plans.registry import query

c = F.col


def raw_listings(v):
    """Listings as text, the way an export shows them."""
    line = c("l_linenumber")
    lst = v.listings("order", "part")
    clock = F.format_string("%02d:%02d", (c("start") / 60).cast("int"), (c("start") % 60).cast("int"))
    half = F.format_string("%d:%02d %s", F.when(c("start") / 60 < 13, (c("start") / 60).cast("int"))
                           .otherwise((c("start") / 60).cast("int") - 12), (c("start") % 60).cast("int"),
                           F.when(c("start") < 720, "am").otherwise("pm"))
    start = 480 + 30 * (c("l_partkey") % 20)
    return (lst.withColumn("start", start.cast("int")).select(
        "listing_id", "l_linenumber",
        F.when(line == 5, "n/a").otherwise(F.concat(F.lit(" "), c("units_text"))).alias("units_raw"),
        F.when(line == 4, "").when(line == 7, "many").otherwise(F.format_string("%,d", c("seat_capacity") * 100))
         .alias("capacity_raw"),
        F.when(line == 3, "noon").when(line % 2 == 0, clock).otherwise(half).alias("start_raw"),
        F.concat(F.lit("  Seat "), c("seat_status")).alias("status_raw")))


@query("b0_standardize", """
SELECT listing_id, 'row' AS part, CASE WHEN l_linenumber <> 5 THEN (p_size % 4)::DOUBLE END AS low,
  CASE WHEN l_linenumber NOT IN (4, 7) THEN seat_capacity * 100 END AS capacity,
  CASE WHEN l_linenumber <> 3 THEN 480 + 30 * (l_partkey % 20) END::INT AS start_min, seat_status AS status,
  NULL::VARCHAR AS rule, NULL::VARCHAR AS raw FROM lst
UNION ALL SELECT listing_id, 'issue', NULL, NULL, NULL, NULL, 'units_invalid', 'n/a' FROM lst WHERE l_linenumber = 5
UNION ALL SELECT listing_id, 'issue', NULL, NULL, NULL, NULL, 'count_invalid', 'many' FROM lst WHERE l_linenumber = 7
UNION ALL SELECT listing_id, 'issue', NULL, NULL, NULL, NULL, 'time_invalid', 'noon' FROM lst WHERE l_linenumber = 3
""")
def b0(v):
    out = standardize(raw_listings(v), "listing_id", [
        Rule("units_invalid", "units_raw", "low", P.units_range(c("units_raw"))["low"]),
        Rule("count_invalid", "capacity_raw", "capacity", P.count_value(c("capacity_raw"))),
        Rule("time_invalid", "start_raw", "start_min", P.clock_minutes(c("start_raw"))),
        Rule("status_invalid", "status_raw", "status", P.status_phrase(F.replace(
            c("status_raw"), F.lit("waitlist"), F.lit("wait list"))))])
    none = F.lit(None).cast("string")
    return (out.rows.select("listing_id", F.lit("row").alias("part"), "low", "capacity", "start_min", "status",
                            none.alias("rule"), none.alias("raw"))
            .unionByName(out.issues.select("listing_id", F.lit("issue").alias("part"), "rule", "raw"),
                         allowMissingColumns=True))


@query("b1_norm_code", """
SELECT p_partkey, upper(p_brand) || ' ' || upper(p_name) AS code,
  replace(replace(upper(p_brand || p_name), '#', ''), ' ', '') AS compact,
  CASE upper(p_brand) WHEN 'BRAND#1' THEN 'B-ONE' WHEN 'BRAND#2' THEN 'B-TWO' ELSE upper(p_brand) END AS aliased
FROM part""")
def b1(v):
    raw = F.concat(F.lit("  "), c("p_brand"), F.lit(" \t "), c("p_name"), F.lit(" "))
    return v.table("part").select("p_partkey", T.norm_code(raw).alias("code"), T.compact_code(raw).alias("compact"),
                                  T.alias_code(c("p_brand"), {"BRAND#1": "B-ONE", "BRAND#2": "B-TWO"})
                                  .alias("aliased"))


@query("b2_slug", """
WITH k AS (SELECT DISTINCT course_code AS code FROM prog UNION SELECT DISTINCT replace(course_code, '#', '-') FROM prog),
s AS (SELECT code, trim(regexp_replace(lower(code), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM k)
SELECT code, slug, count(*) OVER (PARTITION BY slug) > 1 AS collides FROM s""")
def b2(v):
    prog = v.programs().select("course_code")
    codes = prog.union(prog.select(F.replace("course_code", F.lit("#"), F.lit("-")))).distinct() \
        .select(c("course_code").alias("code"), T.slug(c("course_code")).alias("slug"))
    hits = codes.groupBy("slug").agg((F.count_distinct("code") > 1).alias("collides"))
    return codes.join(hits, "slug").select("code", "slug", "collides")


@query("b3_canonical_label", """
SELECT listing_id, CASE WHEN l_tax < 0.02 THEN 'Imperial Valley Campus' WHEN l_tax < 0.06 THEN 'San Diego Campus'
  ELSE 'Global Campus' END AS campus FROM lst""")
def b3(v):
    return v.listings("none").select("listing_id", T.canonical_label(c("campus")).alias("campus"))


@query("b4_natural_key", """
WITH k AS (SELECT DISTINCT course_code AS code FROM prog UNION
           SELECT DISTINCT lower(p_name) || ' ' || p_size || CASE WHEN p_size % 3 = 0 THEN 'B' ELSE '' END FROM part),
p AS (SELECT code, list_transform(regexp_extract_all(lower(code), '(\\d+|\\D+)'), lambda x: {
  'kind': CASE WHEN regexp_matches(x, '^\\d') THEN 0 ELSE 1 END,
  'num': coalesce(TRY_CAST(x AS BIGINT), 0), 'txt': CASE WHEN regexp_matches(x, '^\\d') THEN '' ELSE x END}) AS nk FROM k)
SELECT code, row_number() OVER (ORDER BY nk, code) AS pos FROM p""")
def b4(v):
    part = v.table("part")
    codes = v.programs().select(c("course_code").alias("code")).union(part.select(
        F.concat(F.lower("p_name"), F.lit(" "), c("p_size").cast("string"),
                 F.when(c("p_size") % 3 == 0, "B").otherwise("")))).distinct()
    return ranked(codes.withColumn("nk", T.natural_key(c("code"))), [c("nk").asc(), c("code").asc()]) \
        .select("code", "pos")


@query("b5_term_key", """
WITH t AS (SELECT DISTINCT term, year(o_orderdate) AS y, quarter(o_orderdate) - 1 AS q FROM lst),
now AS (SELECT max(struct_pack(y, q)) AS k FROM t WHERE (y, q) <= (1998, 2))
SELECT term, y::INT AS year, q::INT AS season, (t.y, t.q) = (now.k.y, now.k.q) AS is_current,
  row_number() OVER (ORDER BY y, q) AS pos FROM t, now
UNION ALL SELECT 'Someday', 9999, 99, false, (SELECT count(*) FROM t) + 1""")
def b5(v):
    """Terms in order; the current one is the greatest not after Summer 1998."""
    orders = v.table("orders")
    terms = orders.select(term_of(c("o_orderdate")).alias("term")).distinct()
    odd = v.spark.range(1).select(F.lit("Someday").alias("term"))
    keyed = terms.union(odd).withColumn("k", T.term_key(c("term")))
    limit = F.struct(F.lit(1998).alias("year"), F.lit(2).alias("season"), F.lit("~").alias("term"))
    best = keyed.agg(F.coalesce(F.max(F.when(c("k") <= limit, c("k"))), F.min("k")).alias("best")).scalar()
    return ranked(keyed.withColumn("best", best), [c("k").asc()]).select(
        "term", c("k.year").alias("year"), c("k.season").alias("season"), (c("k") == c("best")).alias("is_current"),
        "pos")


@query("b6_person_name", """
WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS word FROM documents)
SELECT 'word' AS src, word AS raw, trim(regexp_replace(lower(strip_accents(word)), '[^a-z0-9]+', ' ', 'g')) AS person
FROM w WHERE NOT contains(word, ',') AND word <> ''
UNION ALL SELECT 'supplier', replace(s_name, '#', ', '), replace(lower(substr(s_name, 10) || ' ' || substr(s_name, 1, 8)), '#', ' ') FROM supplier
UNION ALL SELECT 'customer', c_name, replace(lower(c_name), '#', ' ') FROM customer""")
def b6(v):
    words = (v.table("documents").select(F.explode(F.split("text", r"\s+")).alias("raw")).distinct()
             .filter(~F.contains("raw", F.lit(",")) & (c("raw") != "")))
    rows = words.select(F.lit("word").alias("src"), "raw").union(
        v.table("supplier").select(F.lit("supplier"), F.replace("s_name", F.lit("#"), F.lit(", ")))).union(
        v.table("customer").select(F.lit("customer"), "c_name"))
    return rows.withColumn("person", T.person_key(c("raw")))


@query("b7_is_placeholder", """
SELECT listing_id, coalesce(instructor, '') IN ('', 'To Be Announced') AS placeholder FROM lst
UNION ALL SELECT 's' || s_suppkey, s_suppkey % 7 < 6 FROM supplier""")
def b7(v):
    odd = F.element_at(F.array(*[F.lit(x) for x in (" STAFF ", "T.B.A", "Announced, To Be", "Instructor  TBA",
                                                    "instructor", "unknown", "Staffan")]),
                       (c("s_suppkey") % 7 + 1).cast("int"))
    odd = F.when(c("s_suppkey") % 7 == 1, "tba").when(c("s_suppkey") % 7 == 2, "to be announced").otherwise(odd)
    return v.listings("supplier").select("listing_id", T.is_placeholder(c("instructor")).alias("placeholder")).union(
        v.table("supplier").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")), T.is_placeholder(odd)))


@query("b8_clean_name", """
SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 5 THEN 'To Be Announced' ELSE s_name || ' Lee' END AS name FROM supplier""")
def b8(v):
    name = F.concat(c("s_name"), F.lit(" Lee"))
    kind = c("s_suppkey") % 6
    raw = (F.when(kind == 0, F.concat(F.lit("TBA - To Be Announced - "), name))
           .when(kind == 1, F.concat(name, F.lit(" / Staff")))
           .when(kind == 2, F.concat_ws(" ", name, name, name, name))
           .when(kind == 3, F.concat(F.lit("Lee, "), c("s_name")))
           .when(kind == 4, F.concat(F.lit("unknown "), name, F.lit("; instructor tba")))
           .otherwise("To Be Announced To Be Announced"))
    return v.table("supplier").select("s_suppkey", T.clean_name(raw).alias("name"))


@query("b9_instruction_mode", """
SELECT listing_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'in_person' WHEN '2-HIGH' THEN 'hybrid'
  WHEN '3-MEDIUM' THEN 'online_with_in_person_exams' WHEN '4-NOT SPECIFIED' THEN 'online_asynchronous'
  ELSE CASE WHEN l_linenumber < 6 THEN 'online_synchronous' ELSE 'online_asynchronous' END END AS by_text,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'in_person' WHEN o_orderpriority = '2-HIGH' THEN 'hybrid'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'other'
  ELSE CASE WHEN l_linenumber < 6 THEN 'online_synchronous' ELSE 'online_asynchronous' END END AS by_codes FROM lst""")
def b9(v):
    prio = c("o_orderpriority")
    text = (F.when(prio == "1-URGENT", "Face-to-Face").when(prio == "2-HIGH", "HYBRID / in person")
            .when(prio == "3-MEDIUM", "Online, with in-person exams")
            .when(prio == "4-NOT SPECIFIED", "Fully Asynchronous").otherwise("Online"))
    codes = (F.when(prio == "1-URGENT", F.array(F.lit("P"), F.lit("face to face")))
             .when(prio == "2-HIGH", F.array(F.lit("P"), F.lit("ON")))
             .when(prio == "3-MEDIUM", F.array(F.lit("Arranged"))).otherwise(F.array(F.lit("Fully Online"))))
    timed = F.exists("meetings", lambda m: m["start_min"].isNotNull())
    return v.listings("order").select("listing_id", P.instruction_mode(text, timed).alias("by_text"),
                                      P.mode_of_codes(codes, timed).alias("by_codes"))


@query("b10_grading_type", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'letter_or_credit_no_credit' WHEN 'LARGE' THEN 'letter'
  WHEN 'MEDIUM' THEN 'credit_no_credit' ELSE 'other' END AS page_value,
  CASE p_type WHEN 'ECONOMY' THEN 'letter_or_credit_no_credit' WHEN 'LARGE' THEN 'letter'
  WHEN 'MEDIUM' THEN 'credit_no_credit' WHEN 'PROMO' THEN 'letter' ELSE 'other' END AS export_value FROM part""")
def b10(v):
    kind = c("p_type")
    page = (F.when(kind == "ECONOMY", "+/-Letter Grade; Credit/No Credit").when(kind == "LARGE", "LETTER-only")
            .when(kind == "MEDIUM", "Cr/NC").otherwise(kind))
    export = F.when(kind == "PROMO", "Graded").otherwise(page)
    return v.table("part").select("p_partkey", P.grading_type(page).alias("page_value"),
                                  P.grading_of_export(export).alias("export_value"))


@query("b11_seat_status", """
WITH x AS (SELECT listing_id, l_linenumber AS n, seat_status AS said, seat_capacity AS cap,
  CASE WHEN l_linenumber <= 2 THEN seats_available END AS avail,
  CASE WHEN l_linenumber IN (3, 4) THEN seat_capacity - l_linenumber + 3 END AS enrolled,
  CASE WHEN l_linenumber = 5 THEN 1 WHEN l_linenumber = 6 THEN 0 END AS waiting FROM lst)
SELECT listing_id, CASE WHEN n % 2 = 1 THEN said WHEN avail > 0 THEN 'open' WHEN enrolled < cap THEN 'open'
  WHEN waiting > 0 THEN 'waitlist' WHEN avail = 0 OR enrolled >= cap THEN 'closed' ELSE 'unknown' END AS status
FROM x""")
def b11(v):
    line = c("l_linenumber")
    said = F.when(line % 2 == 0, "see office").when(c("seat_status") == "waitlist", "Wait List") \
        .when(c("seat_status") == "open", "O").otherwise("FULL")
    return v.listings("order").select("listing_id", P.seat_status(
        said, c("seat_capacity"), F.when(line.isin(3, 4), c("seat_capacity") - line + 3),
        F.when(line <= 2, c("seats_available")), F.when(line == 5, 1).when(line == 6, 0)).alias("status"))


@query("b12_seat_complement", """
SELECT listing_id, seat_capacity - seats_available AS enrolled, greatest(seat_capacity - l_linenumber * 5, 0) AS available,
  l_linenumber AS text_open, seat_capacity AS text_total, greatest(seat_capacity - l_linenumber, 0) AS text_enrolled
FROM lst""")
def b12(v):
    line = c("l_linenumber")
    none = F.lit(None).cast("int")
    text = P.seat_counts(F.concat(F.lit("Open Seats "), line.cast("string"), F.lit(" of "),
                                  c("seat_capacity").cast("string")))
    return v.listings("order").select(
        "listing_id", P.complement(c("seat_capacity"), c("seats_available"), none).alias("enrolled"),
        P.complement(c("seat_capacity"), line * 5, none).alias("available"),
        text["available"].alias("text_open"), text["capacity"].alias("text_total"),
        text["enrolled"].alias("text_enrolled"))


@query("b13_units_range", """
SELECT listing_id, CASE WHEN bad THEN NULL WHEN l_linenumber % 3 = 0 THEN low END AS units,
  CASE WHEN NOT bad THEN low END AS low,
  CASE WHEN NOT bad THEN low + l_linenumber % 3 END AS high, NOT bad AS ok
FROM (SELECT listing_id, l_linenumber, (p_size % 4)::DOUBLE AS low, l_linenumber = 5 AS bad FROM lst)""")
def b13(v):
    low = c("p_size") % 4
    text = F.when(c("l_linenumber") == 5, F.format_string("%d.5 - %d", low + 1, low)).otherwise(c("units_text"))
    return v.listings("part").select("listing_id", P.units_range(text).alias("u")) \
        .select("listing_id", "u.units", "u.low", "u.high", "u.ok")


@query("b14_meeting_text", """
SELECT listing_id, CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 2 THEN 'tue,thu'
  WHEN l_linenumber = 3 THEN 'mon,wed,fri' ELSE lower(strftime(l_shipdate, '%a')) END AS days,
  (hour(ts) * 60 + minute(ts))::INT AS start_min,
  CASE WHEN l_linenumber <> 7 THEN strftime(l_shipdate, '%Y-%m-%d') END AS date_from,
  CASE WHEN l_linenumber <> 7 THEN strftime(l_shipdate + INTERVAL 90 DAY, '%Y-%m-%d') END AS date_to
FROM lst JOIN events ON event_id = l_orderkey % (SELECT count(*) FROM events)""")
def b14(v):
    line = c("l_linenumber")
    n = v.table("events").agg(F.count(F.lit(1)).alias("n"))
    ev = v.table("events").select("event_id", "ts")
    lst = v.listings("none").join(n).withColumn("event_id", c("l_orderkey") % c("n")).join(ev, "event_id")
    word = F.date_format("l_shipdate", "EEEE")
    days = (F.when(line == 7, "Arranged").when(line == 2, "TR").when(line == 3, "M W-F, M")
            .otherwise(F.upper(word)))
    clock = F.when(line % 2 == 0, F.date_format("ts", "hh:mm:ss a")).otherwise(F.date_format("ts", " H:mm"))
    span = F.when(line != 7, F.concat_ws(" - ", F.date_format("l_shipdate", "MM/dd/yyyy"),
                                         F.date_format(F.date_add("l_shipdate", 90), "M/d/yyyy"))).otherwise("TBA")
    r = P.date_range(span)
    return lst.select("listing_id", F.array_join(P.meeting_days(days), ",").alias("days"),
                      P.clock_minutes(clock).alias("start_min"),
                      F.date_format(r["date_from"], "yyyy-MM-dd").alias("date_from"),
                      F.date_format(r["date_to"], "yyyy-MM-dd").alias("date_to"))


_REQ = """
WITH x AS (SELECT DISTINCT p_type, p_size % 12 AS k FROM part)
SELECT p_type, k::INT AS k, CASE k WHEN 0 THEN 'GWAR' WHEN 1 THEN 'American Institutions' WHEN 2 THEN 'Ethnic Studies'
  WHEN 3 THEN '1A English Composition' WHEN 4 THEN '2 Mathematical/Quantitative Reasoning'
  WHEN 5 THEN 'EXPLORATIONS - PHYS, BIO, MATH/QUANT' WHEN 6 THEN 'EXPLORATIONS - SOCIAL & BEHAVIORAL SCIENCES'
  WHEN 7 THEN '4 Social and Behavioral Sciences' WHEN 8 THEN '3B Humanities' WHEN 9 THEN '5C Laboratory' END AS label,
  CASE k WHEN 0 THEN 'GWAR' WHEN 2 THEN 'Ethnic Studies' WHEN 3 THEN '1A English Composition'
  WHEN 4 THEN '2 Mathematical/Quantitative Reasoning' WHEN 5 THEN 'EXPLORATIONS - PHYS, BIO, MATH/QUANT'
  WHEN 6 THEN 'EXPLORATIONS - ARTS & HUMANITIES' WHEN 7 THEN '4 Social and Behavioral Sciences' WHEN 8 THEN '3B Humanities' WHEN 9 THEN '5C Laboratory'
  WHEN 10 THEN '1C Oral Communication' END AS tag FROM x"""


@query("b15_requirement_label", _REQ)
def b15(v):
    # One (code, name, tag text) per branch of the rule table.
    cases = [("gwar", "Writing", "GWAR: writing"), ("ai ", "x", "plain"), ("GE F", "x", "Ethnic  Studies"),
             ("ge 1a", "x", "GE 1A: English"), ("GE B4", "Quantitative", "ge 2: mathematics"),
             ("GE 2", "2 or 5", "Explorations of Quantitative things"), ("GE 4", "Social", "EXPLORATIONS Arts and Humanities"),
             ("GE 4", "6 units", "GE 4: social sciences"), ("GE C2", "Humanities", "GE C2: Humanities"),
             ("GE 5C", "Lab", "GE 5C: laboratory"), ("GE Z", "x", "GE A1: Oral Communication"), ("", "", "")]
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("code", "name", "tag"))]) for row in cases])
    k = (c("p_size") % 12).cast("int")
    return (v.table("part").select("p_type", k.alias("k")).distinct().withColumn("t", F.get(table, c("k")))
            .select("p_type", "k", L.requirement_label(c("t.code"), F.concat(c("t.name"), F.lit(" "), F.lower("p_type")))
                    .alias("label"), L.requirement_tag(c("t.tag")).alias("tag")))


@query("b16_program_signature", """
SELECT DISTINCT p_name, p_type, lower(replace(p_name, ' ', ' and ')) || ' ' || lower(p_type) || ' ba' AS words,
  lower(replace(p_name, ' ', '+')) || '+' || lower(p_type) || '+ba' AS with_degree,
  lower(replace(p_name, ' ', '+')) || '+' || lower(p_type) AS no_degree FROM part""")
def b16(v):
    name = F.concat(F.replace(c("p_name"), F.lit(" "), F.lit(" &amp; ")), F.lit(", Émphasis in the "), c("p_type"),
                    F.lit(" (B.A.)"))
    words = F.concat(F.replace(c("p_name"), F.lit(" "), F.lit(" &amp; ")), F.lit(", "), c("p_type"), F.lit(" (B.A.)"))
    return v.table("part").select("p_name", "p_type").distinct().select(
        "p_name", "p_type", T.program_words(words).alias("words"),
        F.array_join(T.program_signature(name), "+").alias("with_degree"),
        F.array_join(T.program_signature(name, keep_degree=False), "+").alias("no_degree"))


@query("b17_split_subject", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN upper(string_split(p_name, ' ')[1]) ELSE upper(p_name) END AS subject,
  p_size || 'X' AS catalog_number FROM part""")
def b17(v):
    """One- and two-word subjects; the longest known one wins."""
    part = v.table("part")
    first = F.element_at(F.split("p_name", " "), 1)
    known = part.select(F.upper("p_name").alias("subject")).union(part.select(F.upper(first))).distinct()
    text = F.concat(F.when(c("p_size") % 5 == 0, first).otherwise(c("p_name")), F.lit("  "),
                    c("p_size").cast("string"), F.lit("x extra"))
    return split_subject(part.withColumn("t", text), "t", known, "subject", "p_partkey")


@query("b18_url_identity", """
SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]+)', 1))
  || regexp_extract(url, '://[^/?#]+([^?#]*)', 1)
  || CASE WHEN url LIKE '%ref=%' AND url LIKE '%page=%' THEN '?ref=' || regexp_extract(url, '[?&]ref=([^&#]*)', 1) || '&page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1)
     WHEN url LIKE '%page=%' THEN '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1)
     WHEN url LIKE '%ref=%' THEN '?ref=' || regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE '' END AS identity,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  url LIKE 'https://%' AND regexp_matches(url, '://([^/]*\\.)?example\\.net/') AND regexp_matches(url, '://[^/]*/en/') AS allowed
FROM pages""")
def b18(v):
    return v.table("pages").select("page_id", T.url_identity(c("url"), ("ref", "page")).alias("identity"),
                                   T.url_value(c("url"), "page").alias("page"),
                                   T.allowed_url(c("url"), "example.net", "/en/").alias("allowed"))


@query("b19_search_text", """
SELECT listing_id, lower(course_code || ' ' || title || CASE WHEN instructor IS NULL THEN '' ELSE ' ' || instructor END) AS txt
FROM lst""")
def b19(v):
    return v.listings("part", "supplier").select(
        "listing_id", T.search_text(c("course_code"), c("title"), c("instructor")).alias("txt"))


@query("b20_query_terms", """
WITH q AS (SELECT p_partkey, p_name AS name, upper(replace(p_brand, '#', ' ')) AS code FROM part)
SELECT p_partkey, 1 AS no, lower(name) AS s, NULL::VARCHAR AS prefix FROM q
UNION ALL SELECT p_partkey, 2, lower(code), code FROM q UNION ALL SELECT p_partkey, 3, 'lab', NULL FROM q""")
def b20(v):
    text = F.concat(F.lit(' "'), c("p_name"), F.lit('" "'), F.lower(F.replace("p_brand", F.lit("#"), F.lit("  "))),
                    F.lit('" LAB'))
    return (v.table("part").select("p_partkey", F.posexplode(T.query_terms(text)).alias("i", "t"))
            .select("p_partkey", (c("i") + 1).alias("no"), F.regexp_replace("t.s", r"\s+", " ").alias("s"),
                    c("t.prefix").alias("prefix")))


@query("b21_key_columns", """
SELECT listing_id, term_key || '|' || schedule_number AS physical,
  term_key || '|' || subject || '|' || coalesce(crse_id, course_code) || '|' || offer || '|' || career AS offering,
  subject || '|' || coalesce(crse_id, course_code) || '|' || offer || '|' || career AS detail,
  subject || '|' || catalog_number || '|' || career AS identity FROM lst""")
def b21(v):
    return v.listings("order", "part").select(
        "listing_id", K.physical_key(c("term"), c("term_code"), c("schedule_number")).alias("physical"),
        K.offering_key(c("term"), c("term_code"), c("subject"), c("crse_id"), c("course_code"), c("offer"), c("career"))
         .alias("offering"),
        K.detail_key(c("subject"), c("crse_id"), c("course_code"), c("offer"), c("career")).alias("detail"),
        K.catalog_identity(c("subject"), c("catalog_number"), c("career")).alias("identity"))


@query("b22_iso_ts", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def b22(v):
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    east = F.concat(F.date_format(c("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    k = c("event_id") % 4
    raw = F.when(k == 0, plain).when(k == 1, F.concat(plain, F.lit("Z"))).when(k == 2, east).otherwise("soon")
    return v.table("events").select("event_id", F.date_format(P.iso_ts(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("b23_display_labels", """
WITH x AS (SELECT l.*, m.day, m.s, m.e FROM lst l LEFT JOIN (SELECT * FROM meet WHERE no = 1) m USING (listing_id)),
h AS (SELECT *, s // 60 AS sh, e // 60 AS eh FROM x)
SELECT listing_id, CASE instruction_mode WHEN 'in_person' THEN 'In person' WHEN 'online_synchronous' THEN 'Online synchronous'
  WHEN 'hybrid' THEN 'Hybrid' WHEN 'online_asynchronous' THEN 'Online asynchronous' ELSE 'Other' END AS mode,
 CASE seat_status WHEN 'open' THEN 'Open' WHEN 'waitlist' THEN 'Waitlisted' ELSE 'Closed' END AS status,
 CASE WHEN day IS NULL THEN 'TBA' ELSE upper(day[1]) || day[2:] ||
  CASE WHEN s IS NULL THEN '' ELSE ' ' || (CASE WHEN sh % 12 = 0 THEN 12 ELSE sh % 12 END) || ':' || lpad((s % 60)::VARCHAR, 2, '0') || CASE WHEN sh < 12 THEN ' AM' ELSE ' PM' END
   || '–' || (CASE WHEN eh % 12 = 0 THEN 12 ELSE eh % 12 END) || ':' || lpad((e % 60)::VARCHAR, 2, '0') || CASE WHEN eh < 12 THEN ' AM' ELSE ' PM' END END END AS meeting,
 CASE WHEN seats_available IS NULL THEN seat_capacity || ' capacity' ELSE seats_available || ' / ' || seat_capacity END AS seats,
 CASE WHEN units_min IS NULL THEN units::INT || '' WHEN units_min = units_max THEN units_min::INT || ''
  ELSE units_min::INT || '–' || units_max::INT END AS units_label,
 CASE WHEN rating IS NULL THEN 'neutral' WHEN rating >= 4 THEN 'good' WHEN rating >= 2.5 THEN 'mixed' ELSE 'poor' END AS quality,
 CASE WHEN again IS NULL THEN 'neutral' WHEN again >= 80 THEN 'good' WHEN again >= 50 THEN 'mixed' ELSE 'poor' END AS again_tone,
 CASE WHEN difficulty IS NULL THEN 'neutral' WHEN difficulty <= 2 THEN 'good' WHEN difficulty <= 3.5 THEN 'mixed' ELSE 'poor' END AS hard
FROM h""")
def b23(v):
    none = F.lit(None).cast("int")
    m = F.get("meetings", F.lit(0))
    days = F.coalesce(m["days"], F.slice(F.array(F.lit("")), 1, 0))
    return v.listings().select(
        "listing_id", L.label_of(c("instruction_mode"), L.MODE_LABELS).alias("mode"),
        L.label_of(c("seat_status"), L.STATUS_LABELS).alias("status"),
        L.meeting_label(days, m["start_min"], m["end_min"]).alias("meeting"),
        L.seat_label(c("seats_available"), none, c("seat_capacity")).alias("seats"),
        L.units_label(F.coalesce("units_min", "units"), F.coalesce("units_max", "units")).alias("units_label"),
        L.tone(c("metrics.rating"), "quality").alias("quality"), L.tone(c("metrics.again"), "again").alias("again_tone"),
        L.tone(c("metrics.difficulty"), "difficulty").alias("hard"))


@query("b23_freshness_labels", """
WITH x AS (SELECT event_id, greatest(epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts), 0) AS age FROM events),
y AS (SELECT *, age / 3600 AS h FROM x)
SELECT event_id, CASE WHEN age > 1800 THEN 'Stale · updated ' ELSE 'Updated ' END ||
 CASE WHEN age < 90 THEN 'just now' WHEN age < 3600 THEN greatest(1, floor(age / 60 + 0.5))::INT || ' min ago'
  WHEN h < 10 THEN format('{:.1f}', h) || ' hr ago' ELSE floor(h + 0.5)::INT || ' hr ago' END AS seen FROM y""")
def b23_fresh(v):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return v.table("events").select("event_id", L.freshness_label(c("ts"), now).alias("seen"))
