"""Group C: filters over the whole listing table."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.operators import filters as X
from offergrid.operators.filters import FilterSpec
from offergrid.operators.programs import list_programs
from offergrid.plans.registry import query

c = F.col


@query("c1_where_in", """
SELECT listing_id FROM lst WHERE term IN ('Fall 1997', 'Spring 1998') AND seat_status IN ('open', 'waitlist')
 AND instruction_mode = 'hybrid' AND grading IN ('letter', 'other')""")
def c1(v):
    return v.listings("order", "part").filter(
        X.where_in("term", ["Fall 1997", "Spring 1998"]) & X.where_in("seat_status", ["open", "waitlist"])
        & X.where_in("instruction_mode", ["hybrid"]) & X.where_in("grading", ["letter", "other"])
    ).select("listing_id")


@query("c2_where_campus", "SELECT listing_id FROM lst WHERE l_tax < 0.02 OR l_tax >= 0.06")
def c2(v):
    return v.listings("none").filter(X.where_campus(["Imperial Valley", "Global   Campus"])).select("listing_id")


@query("c3_exclude_completed", """
SELECT listing_id FROM lst WHERE course_code NOT IN (SELECT course_code FROM prog WHERE classification = 'elective')""")
def c3(v):
    done = v.programs().filter("classification = 'elective'").select(F.lower("course_code"))
    return X.exclude_completed(v.listings("part"), done).select("listing_id")


@query("c4_where_text", """
SELECT listing_id, 'title' AS q FROM lst WHERE contains(lower(title), 'red ring')
UNION ALL SELECT listing_id, 'who' FROM lst WHERE contains(lower(instructor), 'supplier#000000001')
  AND contains(lower(title), 'blue')
UNION ALL SELECT listing_id, 'code' FROM lst WHERE starts_with(upper(replace(course_code, '#', ' ')), 'BRAND 1')
UNION ALL SELECT listing_id, 'blank' FROM lst""")
def c4(v):
    lst = v.listings("part", "supplier").select(
        "listing_id", "title", "instructor", "course_code",
        F.replace("course_code", F.lit("#"), F.lit(" ")).alias("spaced"))
    asks = [("title", X.where_text('"Red Ring"')), ("who", X.where_text("SUPPLIER#000000001 blue")),
            ("code", X.where_text('"brand 1"', code="spaced")), ("blank", X.where_text("  "))]
    hits = F.array(*[F.when(p, F.lit(q)) for q, p in asks])
    return lst.select("listing_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("q"))


@query("c5_where_requirements", """
SELECT listing_id FROM lst WHERE own_tag = '3A Arts' AND lab_tag IS NOT NULL""")
def c5(v):
    return v.listings("part").filter(X.where_requirements(["3A Arts", "5C Laboratory"])).select("listing_id")


@query("c6_where_units", """
SELECT listing_id FROM lst WHERE coalesce(units_max, units) >= 1.5 AND coalesce(units_min, units) <= 2""")
def c6(v):
    return v.listings("part").filter(X.where_units(1.5, 2)).select("listing_id")


@query("c7_where_program", """
SELECT DISTINCT listing_id, 'elective' AS q FROM progtag
 WHERE program = 'Brand#2' AND year = '2025-2026' AND classification = 'elective'
UNION ALL SELECT DISTINCT listing_id, 'one_tag' FROM progtag
 WHERE program = 'PROMO' AND year = '2026-2027' AND classification IN ('major_prep', 'elective')
UNION ALL SELECT listing_id, 'off' FROM lst""")
def c7(v):
    asks = [("elective", X.where_program("Brand#2", "2025-2026", ["elective"])),
            ("one_tag", X.where_program("PROMO", "2026-2027", ["major_prep", "elective"])),
            ("off", X.where_program("PROMO", major_only=False))]
    hits = F.array(*[F.when(p, F.lit(q)) for q, p in asks])
    return v.listings("part").select("listing_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("q"))


@query("c8_where_days", """
SELECT listing_id FROM meet GROUP BY listing_id HAVING bool_or(day IN ('mon', 'wed')) AND NOT bool_or(day IN ('fri', 'sat'))""")
def c8(v):
    return v.listings("none").filter(X.where_days(["mon", "wed"], ["fri", "sat"])).select("listing_id")


@query("c9_where_time", """
SELECT listing_id FROM meet WHERE s IS NOT NULL GROUP BY listing_id HAVING min(s) >= 600 AND max(e) <= 960""")
def c9(v):
    return v.listings("none").filter(X.where_time(600, 960)).select("listing_id")


@query("c10_where_metrics", """
SELECT listing_id, 'numbers' AS q FROM lst WHERE rating >= 2.5 AND difficulty <= 3 AND again >= 40 AND reviews >= 10
UNION ALL SELECT listing_id, 'flags' FROM lst WHERE attendance IS NOT DISTINCT FROM true
 AND textbook IS NOT DISTINCT FROM false""")
def c10(v):
    asks = [("numbers", X.where_metrics(2.5, 3, 40, 10)), ("flags", X.where_metrics(attendance=True, textbook=False))]
    hits = F.array(*[F.when(p, F.lit(q)) for q, p in asks])
    return v.listings("supplier").select("listing_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("q"))


SPECS = {
    "evening": FilterSpec(statuses=["open", "waitlist"], time_from=780, units_min=1, excluded_days=["fri"]),
    "arts_lab": FilterSpec(requirements=["3A Arts", "5C Laboratory"], campuses=["san diego"]),
    "good": FilterSpec(rating_min=3.5, difficulty_max=3.0, text="red", modes=["hybrid", "in_person"]),
    "major": FilterSpec(program="ECONOMY", year="2026-2027", classes=["major_prep"], gradings=["letter"],
                        days=["mon", "tue"], units_max=2),
}
SPEC_SQL = """
SELECT l.listing_id, spec FROM (
 SELECT listing_id, 'evening' AS spec FROM lst WHERE seat_status IN ('open', 'waitlist')
  AND coalesce(units_max, units) >= 1
  AND listing_id IN (SELECT listing_id FROM meet WHERE s IS NOT NULL GROUP BY 1 HAVING min(s) >= 780)
  AND listing_id NOT IN (SELECT listing_id FROM meet WHERE day = 'fri')
 UNION ALL SELECT listing_id, 'arts_lab' FROM lst WHERE own_tag = '3A Arts' AND lab_tag IS NOT NULL
  AND l_tax >= 0.02 AND l_tax < 0.06
 UNION ALL SELECT listing_id, 'good' FROM lst WHERE rating >= 3.5 AND difficulty <= 3.0
  AND contains(lower(concat_ws(' ', course_code, title, instructor)), 'red')
  AND instruction_mode IN ('hybrid', 'in_person')
 UNION ALL SELECT listing_id, 'major' FROM lst WHERE grading = 'letter' AND coalesce(units_min, units) <= 2
  AND listing_id IN (SELECT listing_id FROM progtag WHERE program = 'ECONOMY' AND year = '2026-2027'
                     AND classification = 'major_prep')
  AND listing_id IN (SELECT listing_id FROM meet WHERE day IN ('mon', 'tue'))) l"""


@query("c11_faceted_filter", f"SELECT listing_id FROM ({SPEC_SQL}) WHERE spec = 'evening'")
def c11(v):
    return X.faceted_filter(v.listings(), SPECS["evening"]).select("listing_id")


@query("c11_batch_search", SPEC_SQL)
def c11_batch(v):
    return X.match_specs(v.listings(), SPECS)


@query("c12_scope", """
SELECT listing_id FROM lst WHERE term = 'Fall 1997' AND subject = 'Brand#1' AND course_code = 'Brand#1 12L'""")
def c12(v):
    return X.scope(v.listings("order", "part"), " Fall 1997 ", "brand#1", " brand#1  12l ").select("listing_id")


@query("c13_list_programs", """
WITH p AS (SELECT DISTINCT program || ' ' || group_name || CASE WHEN p_size % 2 = 0 THEN ', B.A.' ELSE ', B.S.' END AS name, year,
  CASE WHEN p_size % 2 = 0 THEN 'B.A.' ELSE 'B.S.' END AS degree FROM prog JOIN part USING (p_partkey)),
f AS (SELECT *, row_number() OVER (ORDER BY lower(name), year) AS pos, count(*) OVER () AS total FROM p
  WHERE year = '2026-2027' AND contains(lower(name), 'o brand#1') AND lower(degree) = 'b.a.')
SELECT name, year, degree, pos, total, ceil(total / 4)::BIGINT AS pages FROM f WHERE pos BETWEEN 5 AND 8""")
def c13(v):
    """Programs by year, name part and degree, second page of four."""
    degree = F.when(c("p_size") % 2 == 0, "B.A.").otherwise("B.S.")
    progs = v.table("part").select(
        F.concat(c("p_type"), F.lit(" "), c("p_brand"), F.lit(", "), degree).alias("name"),
        F.lit("2026-2027").alias("year"), degree.alias("degree")).distinct()
    return list_programs(progs, "2026-2027", "o brand#1", "B.A.", 2, 4).select("name", "year", "degree", "pos", "total", "pages")


@query("c14_title_filters", """
WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t0, html FROM pages),
x AS (SELECT page_id, html, t0 || CASE page_id % 5 WHEN 0 THEN ', B. S. (credential)' WHEN 1 THEN ' - Four Year Roadmap'
  WHEN 2 THEN ' minor, B.A.' WHEN 3 THEN '' ELSE ' general education' END AS title, page_id % 5 AS k FROM t)
SELECT page_id, 'bachelor' AS kind FROM x WHERE NOT contains(lower(title), 'minor') AND (k = 0 OR contains(lower(title), 'bachelor')
   OR regexp_matches(title, '(?i)(^|[^A-Za-z])(B\\.?\\s*A\\.?|B\\.?\\s*S\\.?|B\\.?\\s*M\\.?)($|[^A-Za-z])'))
UNION ALL SELECT page_id, 'roadmap' FROM x WHERE k = 1
UNION ALL SELECT page_id, 'not_found' FROM x WHERE contains(lower(html), 'resource not found')
UNION ALL SELECT page_id, 'requirement' FROM x WHERE NOT contains(lower(title), 'roadmap') AND k NOT IN (0, 2)
  AND (k = 4 OR regexp_matches(lower(trim(title)), '^(ge\\s+)?(area\\s+)?([1-6][a-c]?|[a-f][1-4]?)\\b'))""")
def c14(v):
    k = c("page_id") % 5
    tail = (F.when(k == 0, ", B. S. (credential)").when(k == 1, " - Four Year Roadmap").when(k == 2, " minor, B.A.")
            .when(k == 3, "").otherwise(" general education"))
    pages = v.table("pages").select("page_id", "html", F.concat(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1), tail).alias("title"))
    out = None
    for kind in ("bachelor", "roadmap", "requirement", "not_found"):
        part = X.title_filters(pages, kind, "title", "html").select("page_id", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out
