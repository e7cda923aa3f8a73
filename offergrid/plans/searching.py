"""Options, audit, sort, page and search (E6, E7, D6, D15, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from offergrid.operators import options as O
from offergrid.operators import search as S
from offergrid.operators.filters import FilterSpec
from offergrid.operators.ordering import ranked
from offergrid.plans.oracle_views import natural
from offergrid.plans.registry import query
from offergrid.session import settled

c = F.col
AZ = (f"{natural('subject')}, {natural('catalog_number')}, {natural('section_number')}, "
      f"coalesce(option_number, 0), {natural('schedule_number')}, option_id")
AZ_DOWN = (f"{natural('subject')} DESC, {natural('catalog_number')} DESC, {natural('section_number')} DESC, "
           f"coalesce(option_number, 0) DESC, {natural('schedule_number')} DESC, option_id DESC")
SHOWN_SQL = """opt_rows AS (SELECT o.option_id, o.primary_id, o.option_number, o.n_members, l.subject, l.catalog_number,
 l.section_number, l.schedule_number, l.rating, l.difficulty, l.reviews, l.again, l.class_difficulty
 FROM opt o JOIN lst l ON o.primary_id = l.listing_id)"""


@query("e7_group_options", "SELECT * FROM opt")
def e7(v):
    return O.group_options(v.listings("order", "part")).options.select(
        "option_id", "kind", "primary_id", "option_number", "n_members")


@query("e7_membership", "SELECT * FROM memb")
def e7_members(v):
    return O.group_options(v.listings("order", "part")).membership.drop("physical")


@query("d15_alias_groups", "SELECT * FROM moved")
def d15(v):
    return O.alias_groups(O.option_bridge(v.listings("order", "part")))


@query("d6_match_options", """
SELECT DISTINCT m.option_id, m.n_members FROM memb m JOIN (SELECT DISTINCT listing_id FROM meet WHERE day = 'sat') s ON s.listing_id = m.listing_id""")
def d6(v):
    """Options of which any member meets on Saturday."""
    lst = v.listings("order", "part")
    opts = O.group_options(lst)
    hit = lst.filter(F.exists("meetings", lambda m: F.array_contains(m["days"], F.lit("sat"))))
    return O.match_options(hit, opts.membership, opts.options).select("option_id", "n_members")


_AUDIT = """
WITH phys AS (SELECT listing_id, term_key || '|' || schedule_number AS physical, course_code, schedule_number, component FROM lst),
po AS (SELECT DISTINCT option_id, physical, n_members FROM memb JOIN phys USING (listing_id)),
cls AS (SELECT physical, count(*) AS m, bool_or(n_members = 1) AS st, bool_or(n_members > 1) AS gr FROM po GROUP BY physical)"""


@query("e6_coverage_audit", _AUDIT + """
SELECT (SELECT count(*) FROM phys) AS listings, (SELECT count(DISTINCT physical) FROM phys) AS physical,
 (SELECT count(*) FROM cls WHERE st) AS standalone, (SELECT count(*) FROM cls WHERE gr) AS grouped,
 (SELECT count(*) FROM po) AS memberships, (SELECT count(*) FROM cls) AS accounted,
 (SELECT count(DISTINCT physical) FROM phys WHERE physical NOT IN (SELECT physical FROM cls)) AS unaccounted,
 (SELECT count(*) FROM po) - (SELECT count(*) FROM cls) AS duplicates, (SELECT count(*) FROM opt) AS options,
 (SELECT count(DISTINCT listing_id) FROM memb) AS represented,
 CASE WHEN EXISTS (SELECT 1 FROM phys WHERE physical NOT IN (SELECT physical FROM cls)) THEN 'failed' ELSE 'passed' END AS status""")
def e6(v):
    lst = settled(v.listings("order", "part").select(*O.GROUPED))
    return O.member_totals(lst, O.option_members(lst))


@query("e6_audit_of_kept_classes", _AUDIT + """,
kept AS (SELECT * FROM phys WHERE physical IN (SELECT physical FROM cls))
SELECT (SELECT count(*) FROM kept) AS listings, (SELECT count(DISTINCT physical) FROM kept) AS physical,
 (SELECT count(*) FROM cls) AS accounted, (SELECT count(DISTINCT physical) FROM kept WHERE physical NOT IN (SELECT physical FROM cls)) AS unaccounted,
 CASE WHEN EXISTS (SELECT 1 FROM kept WHERE physical NOT IN (SELECT physical FROM cls)) THEN 'failed' ELSE 'passed' END AS status""")
def e6_kept(v):
    """The audit over the listings whose class is in some option: it passes."""
    lst = v.listings("order", "part")
    opts = O.group_options(lst)
    kept = O.physical(lst).join(opts.membership.select("physical").distinct(), "physical", "left_semi").drop("physical")
    return O.coverage_audit(kept, opts)[0].select("listings", "physical", "accounted", "unaccounted", "status")


@query("e6_unaccounted_examples", _AUDIT + """
SELECT physical, arg_min(course_code || ' schedule #' || schedule_number || ' (' || component || ')', listing_id) AS example,
 min(listing_id) AS first_id FROM phys WHERE physical NOT IN (SELECT physical FROM cls)
GROUP BY physical ORDER BY first_id LIMIT 20""")
def e6_examples(v):
    lst = v.listings("order", "part")
    return O.coverage_audit(lst, O.group_options(lst))[1].orderBy("first_id").limit(20)


AZ_SOURCES = ("subject", "catalog_number", "section_number", "schedule_number")


def option_table(v, *metrics: str, shown=None):
    """Stored options with what A to Z and the metrics need, or their ``shown`` columns."""
    own = [n for n in metrics if n in S.METRICS]
    lst = v.listings("order", "part", *(["supplier"] if own else []))
    lst = lst.withColumns({n: c("metrics")[n] for n in own}) if own else lst
    return O.stored_options(lst, [*AZ_SOURCES, *metrics], shown)


def _sorted(mode: str, order: str):
    @query(f"g1_sort_{mode}", f"""
WITH {SHOWN_SQL} SELECT option_id, row_number() OVER (ORDER BY {order}) AS pos FROM opt_rows""")
    def g1(v):
        metric = (S.SORT_MODES[mode] or ())[:1]
        rows = option_table(v, *metric, shown=["option_id", "option_number", *AZ_SOURCES, *metric])
        return S.sort_options(rows, mode, stored=True, shown=["option_id"]).select("option_id", "pos")


_sorted("alphabetical", AZ)
_sorted("alphabetical_desc", AZ_DOWN)
for _mode, _metric in S.SORT_MODES.items():
    if _metric:
        _sorted(_mode, f"{_metric[0]} {'DESC' if _metric[1] else 'ASC'} NULLS LAST, {AZ}")


@query("g2_page", f"""
WITH {SHOWN_SQL}, n AS (SELECT count(*) AS total FROM opt_rows)
SELECT option_id, row_number() OVER (ORDER BY {AZ}) AS pos, total, ceil(total / 50)::BIGINT AS pages FROM opt_rows, n
QUALIFY pos > 150 AND pos <= 200""")
def g2(v):
    """Page 4; a size above 50 is taken as 50."""
    return S.page(S.with_az(option_table(v)), S.sort_order("alphabetical"), 4, 80).select("option_id", "pos", "total", "pages")


@query("g2_last_page", f"""
WITH {SHOWN_SQL}, n AS (SELECT count(*) AS total FROM opt_rows)
SELECT option_id, row_number() OVER (ORDER BY {AZ}) AS pos, total, ceil(total / 50)::BIGINT AS pages FROM opt_rows, n
QUALIFY pos > (ceil(total / 50) - 1) * 50""")
def g2_last(v):
    """A page number past the end gives the last page."""
    return S.page(S.with_az(option_table(v)), S.sort_order("alphabetical"), 10 ** 7, 50, stored=True).select(
        "option_id", "pos", "total", "pages")


@query("g2_indexed_last_page", f"""
WITH {SHOWN_SQL}, n AS (SELECT count(*) AS total FROM opt_rows)
SELECT option_id, row_number() OVER (ORDER BY {AZ}) AS pos, total, ceil(total / 50)::BIGINT AS pages FROM opt_rows, n
QUALIFY pos > (ceil(total / 50) - 1) * 50""")
def g2_indexed_last(v):
    """The last page from stored positions: one block is sorted."""
    rows = S.index_orders(S.with_az(option_table(v)), ["alphabetical"], stored=True)
    return S.indexed_page(rows, "alphabetical", 10 ** 7, 50, block=500).select("option_id", "pos", "total", "pages")


@query("g2_indexed_page", f"""
WITH {SHOWN_SQL}, f AS (SELECT * FROM opt_rows WHERE n_members > 1), n AS (SELECT count(*) AS total FROM f),
r AS (SELECT option_id, row_number() OVER (ORDER BY reviews DESC NULLS LAST, {AZ}) AS pos, total FROM f, n)
SELECT 'reviews' AS mode, option_id, pos, total, ceil(total / 50)::BIGINT AS pages FROM r WHERE pos > 4950 AND pos <= 5000
UNION ALL SELECT 'alphabetical_desc', option_id, total + 1 - pos, total, ceil(total / 50)::BIGINT FROM (
 SELECT option_id, row_number() OVER (ORDER BY {AZ}) AS pos, total FROM f, n) WHERE total + 1 - pos > 4950 AND total + 1 - pos <= 5000""")
def g2_indexed(v):
    """Page 100 of a filtered ranking in two modes."""
    rows = S.index_orders(S.with_az(option_table(v, "reviews")), ["reviews"], stored=True).filter("n_members > 1")
    one, two = (S.indexed_page(rows, m, 100, 50, block=500).select(F.lit(m).alias("mode"), "option_id", "pos", "total", "pages")
                for m in ("reviews", "alphabetical_desc"))
    return one.unionByName(two)


FLAGSHIP = FilterSpec(statuses=["open"], units_min=1, units_max=3, time_from=600, time_to=1080,
                      days=["mon", "wed", "thu"], page=1, page_size=50)


@query("g3_search", f"""
WITH {SHOWN_SQL}, hit AS (SELECT DISTINCT option_id FROM memb WHERE listing_id IN (
  SELECT listing_id FROM lst WHERE seat_status = 'open' AND coalesce(units_max, units) >= 1 AND coalesce(units_min, units) <= 3
  AND listing_id IN (SELECT listing_id FROM meet WHERE s IS NOT NULL GROUP BY 1 HAVING min(s) >= 600 AND max(e) <= 1080)
  AND listing_id IN (SELECT listing_id FROM meet WHERE day IN ('mon', 'wed', 'thu')))),
pg AS (SELECT *, row_number() OVER (ORDER BY {AZ}) AS pos, count(*) OVER () AS total FROM opt_rows
  WHERE option_id IN (SELECT option_id FROM hit) QUALIFY pos <= 50)
SELECT pos, pg.option_id, primary_id, pg.option_number, pg.n_members, total, ceil(total / 50)::BIGINT AS pages,
 (SELECT count(*) FROM opt) AS unfiltered, m.listing_id, l.component, l.seat_status, l.seats_available, l.section_number,
 l.schedule_number, l.instructor, CASE l.component WHEN 'Lecture' THEN 0 WHEN 'Activity' THEN 3 ELSE 4 END AS component_rank
FROM pg JOIN memb m ON pg.option_id = m.option_id JOIN lst l ON m.listing_id = l.listing_id""")
def g3(v):
    lst = v.listings()
    return S.search(lst, S.publish_grouping(lst), FLAGSHIP)


@query("g4_canonical_order", """
SELECT listing_id, row_number() OVER (ORDER BY year(o_orderdate), quarter(o_orderdate), lower(subject), lower(catalog_number),
 section_number, schedule_number, listing_id) AS pos FROM lst""")
def g4(v):
    return ranked(S.with_term_key(v.listings("order", "part").select(
        "listing_id", "term", "subject", "catalog_number", "section_number", "schedule_number")), S.canonical_keys()).select("listing_id", "pos")
