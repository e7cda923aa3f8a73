"""Group E: counts, coverage, rollups, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.operators import options as G
from offergrid.operators import overlays as O
from offergrid.operators import programs as P
from offergrid.operators import rollups as R
from offergrid.operators.filters import FilterSpec
from offergrid.operators.seats import seat_rules
from offergrid.plans.registry import query

c = F.col


def phys(v, *needs):
    return G.physical(v.listings(*needs))


@query("e1_inventory_counts", """
SELECT count(*) AS listings, count(DISTINCT term_key || '|' || subject || '|' || coalesce(crse_id, course_code) || '|' || offer
 || '|' || career) AS offerings, count(DISTINCT physical) AS physical, count(DISTINCT subject) AS subjects,
 count(DISTINCT term) AS terms FROM lst""")
def e1(v):
    return R.inventory_counts(v.listings("order", "part"))


@query("e2_filter_options", """
WITH vals AS (SELECT DISTINCT 'term' AS facet, term AS value, year(o_orderdate) * 100 + quarter(o_orderdate) AS r FROM lst
UNION SELECT 'campus', CASE WHEN l_tax < 0.02 THEN 'Imperial Valley Campus' WHEN l_tax < 0.06 THEN 'San Diego Campus' ELSE 'Global Campus' END,
  CASE WHEN l_tax < 0.02 THEN 1 WHEN l_tax < 0.06 THEN 0 ELSE 2 END FROM lst
UNION SELECT 'grading', grading, list_position(['letter','credit_no_credit','letter_or_credit_no_credit','other'], grading) FROM lst
UNION SELECT 'mode', instruction_mode, list_position(['in_person','online_synchronous','online_asynchronous','x','hybrid','other'], instruction_mode) FROM lst
UNION SELECT 'status', seat_status, list_position(['open','waitlist','closed'], seat_status) FROM lst
UNION SELECT 'instructor', instructor, 0 FROM lst WHERE instructor <> 'To Be Announced'
UNION SELECT 'requirement', tag, list_position(['GWAR','American Institutions','Ethnic Studies','Cultural Diversity','3A Arts',
  '3B Humanities','5A Physical Science','5B Biological Science','5C Laboratory'], tag) FROM reqtag
UNION SELECT 'program', program, 0 FROM progtag UNION SELECT 'year', year, -substr(year, 1, 4)::INT FROM progtag
UNION SELECT 'class', classification, list_position(['major_prep','major_course','elective'], classification) FROM progtag)
SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY r, CASE WHEN facet = 'instructor' THEN lower(value) ELSE value END, value) AS pos FROM vals""")
def e2(v):
    return R.filter_options(v.listings())


@query("e3_facet_counts", """
SELECT 'seat_status' AS facet, seat_status AS value, count(*) AS n FROM lst GROUP BY ALL
UNION ALL SELECT 'grading', grading, count(*) FROM lst GROUP BY ALL
UNION ALL SELECT 'instruction_mode', instruction_mode, count(*) FROM lst GROUP BY ALL""")
def e3(v):
    return R.facet_counts(v.listings("order", "part"), ["seat_status", "grading", "instruction_mode"])


FACET_SPEC = FilterSpec(statuses=["open"], modes=["hybrid", "in_person"], gradings=["letter", "other"], units_min=1)


@query("e3_facet_counts_excluding", """
WITH f AS (SELECT *, seat_status = 'open' AS s, instruction_mode IN ('hybrid', 'in_person') AS m,
 grading IN ('letter', 'other') AS g FROM lst WHERE coalesce(units_max, units) >= 1)
SELECT 'status' AS facet, seat_status AS value, count(*) AS n FROM f WHERE m AND g GROUP BY ALL
UNION ALL SELECT 'mode', instruction_mode, count(*) FROM f WHERE s AND g GROUP BY ALL
UNION ALL SELECT 'grading', grading, count(*) FROM f WHERE s AND m GROUP BY ALL""")
def e3_excluding(v):
    return R.facet_counts_excluding(v.listings("order", "part"), FACET_SPEC, {
        "status": "seat_status", "mode": "instruction_mode", "grading": "grading"})


_FIELDS = {"section_number": "true", "description": "description IS NOT NULL", "component": "true", "campus": "true",
           "location": "location IS NOT NULL", "instructor": "instructor IS NOT NULL", "meetings": "l_linenumber <> 7",
           "timed_meetings": "l_linenumber < 6", "seat_capacity": "true",
           "seats_available": "seats_available IS NOT NULL", "class_difficulty": "class_difficulty IS NOT NULL",
           "crse_id": "crse_id IS NOT NULL", "units_min": "units_min IS NOT NULL",
           "option_number": "option_number IS NOT NULL", "metrics": "has_metrics", "source_url": "true"}


@query("e4_field_coverage", " UNION ALL ".join(
    f"SELECT '{n}' AS field, count(*) AS total, count(*) FILTER (WHERE {x}) AS present, "
    f"count(*) FILTER (WHERE NOT ({x})) AS missing, round(count(*) FILTER (WHERE {x}) / count(*) * 100, 2) AS percent FROM lst"
    for n, x in _FIELDS.items()))
def e4(v):
    return R.field_coverage(v.listings())


@query("e4_coverage_examples", "WITH x AS (" + " UNION ".join(
    f"SELECT '{n}' AS field, course_code || ' / ' || schedule_number AS example FROM lst WHERE NOT ({x})"
    for n, x in _FIELDS.items() if x != "true") + """)
SELECT field, example, row_number() OVER (PARTITION BY field ORDER BY example) AS rank FROM x QUALIFY rank <= 10""")
def e4_examples(v):
    return R.coverage_examples(v.listings())


@query("e5_completeness", """
WITH p AS (SELECT physical, bool_or(coalesce(instructor, 'To Be Announced') <> 'To Be Announced') AS i,
 bool_or(location IS NOT NULL) AS l, bool_or(l_linenumber <> 7) AS m FROM lst GROUP BY physical)
SELECT count(*) AS physical, count(*) FILTER (WHERE NOT i) AS missing_instructor, count(*) FILTER (WHERE NOT l) AS missing_location,
 count(*) FILTER (WHERE NOT m) AS missing_meetings FROM p""")
def e5(v):
    return R.completeness(v.listings("order", "supplier"))


@query("e8_representative", """
WITH n AS (SELECT subject, title, count(*) AS n FROM lst GROUP BY ALL)
SELECT subject, arg_min(title, struct_pack(a := -n, b := lower(title), c := title)) AS title, max(n) AS n_top,
 count(*) AS n_values FROM n GROUP BY subject""")
def e8(v):
    return R.representative(v.listings("part"), "subject", "title")


_COURSES = """
WITH o AS (SELECT upper(l.course_code) AS code, l.* FROM opt JOIN lst l ON primary_id = listing_id),
t AS (SELECT code, title, count(*) AS n FROM o GROUP BY ALL),
tt AS (SELECT code, arg_min(title, struct_pack(a := -n, b := lower(title), c := title)) AS title, count(*) AS n_titles FROM t GROUP BY code),
d AS (SELECT code, description, count(*) AS n FROM o WHERE description IS NOT NULL GROUP BY ALL),
dd AS (SELECT code, arg_min(description, struct_pack(a := -n, b := lower(description), c := description)) AS description FROM d GROUP BY code),
f AS (SELECT code, count(*) AS option_count, min(upper(subject)) AS subject,
 string_agg(DISTINCT CASE WHEN l_tax < 0.02 THEN 'Imperial Valley Campus' WHEN l_tax < 0.06 THEN 'San Diego Campus' ELSE 'Global Campus' END, ', ' ORDER BY CASE WHEN l_tax < 0.02 THEN 'Imperial Valley Campus' WHEN l_tax < 0.06 THEN 'San Diego Campus' ELSE 'Global Campus' END) AS campuses,
 string_agg(DISTINCT CASE instruction_mode WHEN 'in_person' THEN 'In person' WHEN 'online_synchronous' THEN 'Online synchronous' WHEN 'hybrid' THEN 'Hybrid' WHEN 'online_asynchronous' THEN 'Online asynchronous' ELSE 'Other' END, ', ' ORDER BY CASE instruction_mode WHEN 'in_person' THEN 'In person' WHEN 'online_synchronous' THEN 'Online synchronous' WHEN 'hybrid' THEN 'Hybrid' WHEN 'online_asynchronous' THEN 'Online asynchronous' ELSE 'Other' END) AS modes,
 CASE WHEN count(DISTINCT units_text) = 1 THEN min(units_text)
  WHEN min(coalesce(units_min, units)) = max(coalesce(units_max, units)) THEN min(coalesce(units_min, units))::INT || ''
  ELSE min(coalesce(units_min, units))::INT || '–' || max(coalesce(units_max, units))::INT END AS units_text FROM o GROUP BY code),
courses AS (SELECT code, option_count, subject, campuses, modes, units_text, title, description, n_titles,
 trim(regexp_replace(lower(code), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM f JOIN tt USING (code) LEFT JOIN dd USING (code))"""


# What the rollup reads of an option's primary listing.
ROLLED = ("course_code", "subject", "title", "description", "campus", "instruction_mode", "units", "units_min", "units_max", "units_text")


def courses(v):
    """The columns travel with the grouping: the listings are read once, and the stored options by every step of the rollup."""
    rows = G.stored_options(v.listings("order", "part"), ROLLED, shown=ROLLED)
    return R.course_rollup(rows).drop("prerequisite_text", "enrollment_requirements")


@query("e9_course_rollup", _COURSES + " SELECT * FROM courses")
def e9(v):
    return courses(v)


@query("e9_subject_rollup", _COURSES + """
SELECT subject, count(*) AS courses, sum(option_count)::BIGINT AS options, replace(lower(subject), '#', '-') AS slug
FROM courses GROUP BY subject""")
def e9_subjects(v):
    return R.subject_rollup(courses(v))


@query("e10_sitemap_rows", _COURSES + """
SELECT unnest(['/', '/privacy', '/terms', '/subjects']) AS path UNION SELECT '/courses/' || slug FROM courses
UNION SELECT '/subjects/' || replace(lower(subject), '#', '-') FROM courses""")
def e10(v):
    return R.sitemap_rows(courses(v))


_PEOPLE = """
WITH p AS (SELECT replace(lower(instructor), '#', ' ') AS person, min(instructor) AS name, count(DISTINCT course_code) AS n_codes,
 bool_or(has_metrics) AS matched FROM lst WHERE instructor <> 'To Be Announced' GROUP BY 1)"""


@query("e11_instructor_inventory", _PEOPLE + " SELECT * FROM p")
def e11(v):
    return R.instructor_inventory(v.listings("part", "supplier"))


@query("e11_instructor_codes", """
SELECT DISTINCT replace(lower(instructor), '#', ' ') AS person, upper(course_code) AS code FROM lst WHERE instructor <> 'To Be Announced'""")
def e11_codes(v):
    return R.instructor_codes(v.listings("part", "supplier")).select("person", "code")


@query("e11_match_rate", _PEOPLE + """
SELECT count(*) AS instructors, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS unmatched,
 round(count(*) FILTER (WHERE matched) / count(*) * 100, 1) AS rate FROM p""")
def e11_rate(v):
    return R.match_rate(R.instructor_inventory(v.listings("part", "supplier")))


@query("e12_cross_listed", """
WITH p AS (SELECT DISTINCT physical, upper(course_code) AS code FROM lst)
SELECT physical, code, count(*) OVER (PARTITION BY physical) AS n_codes FROM p QUALIFY n_codes > 1""")
def e12(v):
    return R.cross_listed(v.listings("order", "part"))


def requirement_pages(v):
    """One row per page, requirement and code; the same requirement is on many pages."""
    return v.programs().filter("label IS NOT NULL").select(
        "year", c("group_name").alias("code"), c("label").alias("name"), "course_code", c("p_partkey").alias("seq"),
        F.concat(F.lit("https://catalog.example.edu/"), c("p_partkey").cast("string")).alias("url"))


@query("e19_merge_requirements", """
SELECT year, group_name AS code, label AS name, 'https://catalog.example.edu/' || min(p_partkey) AS url,
 count(DISTINCT course_code) AS n_codes FROM prog WHERE label IS NOT NULL GROUP BY ALL""")
def e19(v):
    return R.merge_requirements(requirement_pages(v))[0]


@query("e19_requirement_codes", """
SELECT DISTINCT year, group_name AS code, label AS name, course_code FROM prog WHERE label IS NOT NULL""")
def e19_codes(v):
    return R.merge_requirements(requirement_pages(v))[1]


_SCHED = "WITH s AS (SELECT DISTINCT upper(course_code) AS code FROM lst WHERE seat_status <> 'closed' AND term = 'Fall 1997')"


def scheduled(v):
    return v.listings("order", "part").filter("seat_status <> 'closed' AND term = 'Fall 1997'").select("course_code")


@query("e20_program_summary", _SCHED + """
SELECT program, year, count(DISTINCT upper(course_code)) AS mapped,
 count(DISTINCT upper(course_code)) FILTER (WHERE classification = 'major_prep') AS major_prep,
 count(DISTINCT upper(course_code)) FILTER (WHERE classification = 'major_course') AS major_course,
 count(DISTINCT upper(course_code)) FILTER (WHERE classification = 'elective') AS elective,
 count(DISTINCT upper(course_code)) FILTER (WHERE upper(course_code) IN (SELECT code FROM s)) AS scheduled
FROM prog GROUP BY ALL""")
def e20(v):
    return P.program_summary(v.programs(), scheduled(v))


@query("e20_program_detail", """
SELECT program, year, classification, group_name, upper(course_code) AS code, min(note) AS note, count(DISTINCT note) AS notes,
 list_position(['major_prep','major_course','elective'], classification)::INT - 1 AS class_order FROM prog GROUP BY ALL""")
def e20_detail(v):
    return P.program_detail(v.programs())


@query("e20_requirement_list", """
SELECT label, year, count(DISTINCT course_code) AS courses FROM prog WHERE label IS NOT NULL GROUP BY ALL""")
def e20_requirements(v):
    return P.requirement_list(v.programs())


@query("e20_program_list", """
WITH f AS (SELECT DISTINCT program AS name, year FROM prog WHERE contains(lower(program), 'a')),
n AS (SELECT *, row_number() OVER (ORDER BY lower(name), year) AS pos, count(*) OVER () AS total FROM f)
SELECT name, n.year, pos, total, count(DISTINCT upper(course_code)) AS mapped,
 count(DISTINCT upper(course_code)) FILTER (WHERE classification = 'major_prep') AS major_prep,
 count(DISTINCT upper(course_code)) FILTER (WHERE classification = 'major_course') AS major_course,
 count(DISTINCT upper(course_code)) FILTER (WHERE classification = 'elective') AS elective
FROM n JOIN prog ON program = name AND prog.year = n.year WHERE pos <= 3 GROUP BY ALL""")
def e20_list(v):
    """The first page of three with counts per item."""
    progs = v.programs().select(c("program").alias("name"), "year").distinct().withColumn("degree", F.lit("B.A."))
    return P.program_list(progs, v.programs(), name_part="A", number=1, size=3).select(
        "name", "year", "pos", "total", "mapped", "major_prep", "major_course", "elective")


@query("e20_requirement_detail", """
SELECT DISTINCT label, year, upper(course_code) AS code, (SELECT count(DISTINCT upper(course_code)) FROM prog WHERE label = 'GWAR') AS courses
FROM prog WHERE label = 'GWAR'""")
def e20_requirement(v):
    return P.requirement_detail(v.programs(), " gwar ", "2026-2027")


@query("e21_profile_progress", _SCHED + """,
pc AS (SELECT DISTINCT program, year, upper(course_code) AS code FROM prog),
fixed AS (SELECT DISTINCT program, year, upper(course_code) AS code FROM prog WHERE classification <> 'elective'),
el AS (SELECT DISTINCT program, year, group_name AS grp, upper(course_code) AS code FROM prog p WHERE classification = 'elective'
 AND NOT EXISTS (SELECT 1 FROM fixed f WHERE f.program = p.program AND f.code = upper(p.course_code))),
asked AS (SELECT program, year, grp, CASE grp WHEN 'Brand#1' THEN least(2, count(*)) WHEN 'Brand#2' THEN least(1, count(*)) ELSE count(*) END AS a FROM el GROUP BY program, year, grp),
need AS (SELECT program, coalesce((SELECT count(*) FROM fixed f WHERE f.program = x.program), 0)
  + coalesce((SELECT sum(a) FROM asked k WHERE k.program = x.program), 0) AS required FROM (SELECT DISTINCT program FROM prog) x),
done AS (SELECT DISTINCT o_custkey AS student, p_type AS program, '2026-2027' AS year, upper(course_code) AS code FROM lst),
tot AS (SELECT program, count(*) AS mapped, count(*) FILTER (WHERE code IN (SELECT code FROM s)) AS scheduled FROM pc GROUP BY 1),
own AS (SELECT student, d.program, count(*) AS completed, count(*) FILTER (WHERE d.code IN (SELECT code FROM s)) AS ds
 FROM done d JOIN pc ON d.program = pc.program AND d.code = pc.code GROUP BY ALL),
core AS (SELECT student, d.program, count(*) AS n FROM done d JOIN fixed f ON d.program = f.program AND d.code = f.code GROUP BY ALL),
ex AS (SELECT student, d.program, el.grp, count(*) AS k FROM done d JOIN el ON d.program = el.program AND d.code = el.code GROUP BY ALL),
exs AS (SELECT student, ex.program, sum(least(k, a)) AS n FROM ex JOIN asked ON ex.program = asked.program AND ex.grp = asked.grp GROUP BY ALL)
SELECT st.student, st.program, '2026-2027' AS year, mapped, scheduled, coalesce(completed, 0) AS completed, required::BIGINT AS required,
 (coalesce(core.n, 0) + coalesce(exs.n, 0))::BIGINT AS completed_required, scheduled - coalesce(ds, 0) AS remaining_scheduled
FROM (SELECT DISTINCT student, program FROM done) st JOIN tot ON st.program = tot.program JOIN need ON st.program = need.program
LEFT JOIN own ON own.student = st.student AND own.program = st.program
LEFT JOIN core ON core.student = st.student AND core.program = st.program
LEFT JOIN exs ON exs.student = st.student AND exs.program = st.program""")
def e21(v):
    """Customers as students; what they ordered is completed."""
    done = v.listings("order", "part").select(c("o_custkey").alias("student"), c("p_type").alias("program"),
                                              F.lit("2026-2027").alias("year"), "course_code")
    return P.profile_progress(v.programs(), scheduled(v), done, {"Brand#1": 2, "Brand#2": 1})


@query("e22_source_registry", """
WITH s AS (SELECT source_url, schedule_number FROM lst GROUP BY ALL),
w AS (SELECT source_url, min(listing_id) AS id FROM lst WHERE crse_id IS NOT NULL AND term_code <> '' GROUP BY 1)
SELECT l.source_url, count(DISTINCT l.course_code) AS n_codes, (SELECT count(*) FROM s WHERE s.source_url = l.source_url) AS n_classes,
 min(w.id) AS recovery_listing, min(r.crse_id) AS recovery_crse_id, min(r.subject) AS recovery_subject, min(r.term) AS recovery_term
FROM lst l LEFT JOIN w ON w.source_url = l.source_url LEFT JOIN lst r ON r.listing_id = w.id GROUP BY l.source_url""")
def e22(v):
    return R.source_registry(v.listings("order", "part"))[0]


@query("e22_source_classes", """
SELECT source_url, schedule_number, arg_min(term_key, listing_id) AS term_key FROM lst GROUP BY ALL""")
def e22_classes(v):
    return R.source_registry(v.listings("order", "part"))[1]


@query("e23_freshness_by_term", """
WITH k AS (SELECT physical, min(term) AS term FROM lst GROUP BY 1),
j AS (SELECT k.term, n.physical IS NOT NULL AS cached, epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(n.ts) AS age
 FROM k LEFT JOIN newest n ON k.physical = n.physical)
SELECT term, count(*) AS total, count(*) FILTER (WHERE cached) AS cached, count(*) FILTER (WHERE cached AND greatest(age, 0) <= 864000) AS fresh,
 count(*) FILTER (WHERE cached AND age > 864000) AS stale, 0::BIGINT AS pending, count(*) FILTER (WHERE NOT cached) AS uncached,
 round(count(*) FILTER (WHERE cached AND greatest(age, 0) <= 864000) / count(*) * 100, 1) AS percent FROM j GROUP BY term""")
def e23(v):
    seats = O.newest(seat_rules(v.observations()), "physical", ["ts", "event_id"])
    return R.freshness_by_term(phys(v, "order"), seats, F.lit("2024-01-20 00:00:00").cast("timestamp"), 864000)


@query("e24_placeholder_targets", """
WITH t AS (SELECT physical, source_url, l_suppkey IN (SELECT user_id FROM upd WHERE kind = 'open' AND seats > 30) AS live FROM lst
 WHERE coalesce(instructor, 'To Be Announced') = 'To Be Announced')
SELECT count(DISTINCT physical) AS classes, count(DISTINCT physical) FILTER (WHERE live) AS refreshable,
 count(DISTINCT source_url) FILTER (WHERE live) AS pages FROM t""")
def e24(v):
    live = v.updates().filter("kind = 'open' AND seats > 30").select(
        F.concat(F.lit("https://classes.example.edu/s/"), c("user_id").cast("string")).alias("source_url"))
    return R.placeholder_targets(phys(v, "order", "supplier"), live)


@query("e25_term_counts", """
WITH a AS (SELECT term, count(*) AS listings, count(DISTINCT physical) AS physical FROM lst GROUP BY 1),
b AS (SELECT term, count(*) AS previous FROM lst WHERE l_tax < 0.06 AND term <> 'Fall 1996' GROUP BY 1)
SELECT a.term, listings, physical, previous, listings - previous AS change FROM a LEFT JOIN b ON a.term = b.term""")
def e25(v):
    lst = phys(v, "order")
    return R.term_counts(lst, lst.filter("l_tax < 0.06 AND term <> 'Fall 1996'"))


@query("e25_subject_changes", """
SELECT DISTINCT subject AS value, 'added' AS change FROM lst WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND subject NOT IN
 (SELECT subject FROM lst WHERE l_shipdate < TIMESTAMP '1998-01-01' AND p_size > 20 AND subject < 'Brand#2')
UNION ALL SELECT DISTINCT subject, 'removed' FROM lst WHERE l_shipdate < TIMESTAMP '1998-01-01' AND p_size > 20 AND subject < 'Brand#2' AND subject NOT IN
 (SELECT subject FROM lst WHERE l_shipdate >= TIMESTAMP '1998-01-01')""")
def e25_subjects(v):
    lst = v.listings("part")
    return R.set_changes(lst.filter("l_shipdate >= '1998-01-01'"),
                         lst.filter("l_shipdate < '1998-01-01' AND p_size > 20 AND subject < 'Brand#2'"), "subject")


@query("e27_error_rollup", """
SELECT user_id, k, count(*) AS occurrences, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at
FROM upd WHERE kind = 'failure' GROUP BY ALL""")
def e27(v):
    rows = R.error_rollup(v.updates().filter("kind = 'failure'"), ["user_id", "k"])
    return rows.select("user_id", "k", "occurrences", *[F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
                                                       for n in ("first_at", "last_at")])


@query("e28_latency_stats", """
SELECT count(*) AS n, round(sum(value), 2) AS total, round(median(value), 4) AS median, quantile_disc(value, 0.95) AS p95,
 max(value) AS max, max(value) >= 60 AS has_slow FROM events""")
def e28(v):
    return R.latency_stats(v.table("events"), "value", "event_id", 60)


def signals(v):
    kinds = v.observations()
    return kinds.filter("said = 'closed'").select("physical", F.lit("missing_grid").alias("signal")).union(
        kinds.filter("said = 'unknown'").select("physical", F.lit("hidden")))


def new_pages(v):
    return v.updates().filter("kind = 'failure' AND seats > 50").select(
        F.concat(F.lit("https://classes.example.edu/s/"), c("user_id").cast("string")).alias("source_url"))


_SIGNALS = """
WITH cs AS (SELECT DISTINCT physical, CASE said WHEN 'closed' THEN 'missing_grid' ELSE 'hidden' END AS signal FROM obs WHERE said IN ('closed', 'unknown')),
np AS (SELECT DISTINCT user_id FROM upd WHERE kind = 'failure' AND seats > 50),
r AS (SELECT term, course_code, subject || '|' || coalesce(crse_id, course_code) || '|' || offer || '|' || career AS course_key,
  schedule_number, physical, l_suppkey FROM lst)"""


@query("e29_rescrape_targets", _SIGNALS + """
SELECT term, course_code, course_key, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM (
 SELECT r.*, signal FROM r JOIN cs ON r.physical = cs.physical
 UNION ALL SELECT r.*, 'new_class_number' FROM r WHERE l_suppkey IN (SELECT user_id FROM np)) GROUP BY ALL""")
def e29(v):
    return R.rescrape_targets(phys(v, "order", "part"), signals(v), new_pages(v))[0]


@query("e29_rescrape_classes", _SIGNALS + """
SELECT DISTINCT term, course_code, course_key, schedule_number FROM r WHERE physical IN (SELECT physical FROM cs)""")
def e29_classes(v):
    return R.rescrape_targets(phys(v, "order", "part"), signals(v), new_pages(v))[1]


@query("e30_removal_candidates", _SIGNALS + """,
p AS (SELECT physical, min(course_code) AS course_code, bool_or(l_suppkey IN (SELECT user_id FROM np)) AS failed,
 count(DISTINCT course_code || '/' || coalesce(crse_id, '')) > 1 AS crosslisted FROM lst GROUP BY physical),
j AS (SELECT p.*, greatest(round((epoch(TIMESTAMP '2024-01-25 00:00:00') - epoch(n.ts)) / 3600, 1), 0) AS age,
 p.physical IN (SELECT physical FROM cs WHERE signal = 'missing_grid') AS missing FROM p LEFT JOIN newest n ON p.physical = n.physical)
SELECT physical, course_code, CASE WHEN age IS NOT NULL THEN age END AS age_hours, failed, missing, crosslisted,
 CASE WHEN failed OR missing THEN 'suspected' ELSE 'stale' END AS status FROM j WHERE age >= 48 OR failed OR missing""")
def e30(v):
    seats = O.newest(seat_rules(v.observations()), "physical", ["ts", "event_id"])
    missing = signals(v).filter("signal = 'missing_grid'").select("physical")
    return R.removal_candidates(phys(v, "order", "part"), seats, new_pages(v), missing,
                                F.lit("2024-01-25 00:00:00").cast("timestamp"))


@query("e31_duplicate_keys", """
SELECT 'listing_id' AS kind, listing_id AS key, count(*) AS n FROM lst GROUP BY listing_id HAVING count(*) > 1
UNION ALL SELECT 'term_code_schedule', term || '|' || course_code || '|' || schedule_number, count(*) FROM lst GROUP BY 2 HAVING count(*) > 1""")
def e31(v):
    return R.duplicate_keys(v.listings("order", "part"))


@query("e32_subject_inventory", """
WITH seed AS (SELECT p_brand AS subject, min(p_partkey) AS pos FROM part WHERE p_size < 25 GROUP BY 1 HAVING p_brand <> 'Brand#7'),
seen AS (SELECT DISTINCT subject FROM lst WHERE subject NOT IN ('Brand#3', 'Brand#9'))
SELECT coalesce(s.subject, d.subject) AS subject, s.subject IS NULL AS is_new, d.subject IS NULL AS not_seen,
 row_number() OVER (ORDER BY s.pos NULLS LAST, coalesce(s.subject, d.subject)) AS pos FROM seed s FULL JOIN seen d ON s.subject = d.subject""")
def e32(v):
    seed = v.table("part").filter("p_size < 25 AND p_brand <> 'Brand#7'").groupBy(c("p_brand").alias("subject")) \
        .agg(F.min("p_partkey").alias("pos"))
    return R.subject_inventory(seed, v.listings("part").filter(~c("subject").isin("Brand#3", "Brand#9")))
