"""The same views as DuckDB SQL, flat: list columns become side tables."""

from __future__ import annotations

_TAGS = ("['GWAR','American Institutions','Ethnic Studies','Cultural Diversity','3A Arts',"
         "'3B Humanities','5A Physical Science','5B Biological Science']")
_CLASSES = "['major_prep','major_course','elective']"


def _term(ts: str) -> str:
    return f"['Winter','Spring','Summer','Fall'][quarter({ts})] || ' ' || year({ts})"


def _code(ts: str) -> str:
    return f"CASE WHEN quarter({ts}) = 1 THEN '' ELSE year({ts})::VARCHAR || quarter({ts}) END"


VIEWS = {
    "lst": f"""
SELECT l.*, o.o_orderdate, o.o_custkey, o.o_orderpriority, o.o_orderstatus, p.p_size, p.p_type, s.s_nationkey,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS listing_id,
  l_suppkey || '-' || l_quantity::INT AS schedule_number,
  l_linenumber::VARCHAR AS section_number, (l_linenumber % 2 + 1)::VARCHAR AS offer,
  CASE l_returnflag WHEN 'N' THEN 'Lecture' WHEN 'A' THEN 'Activity' WHEN 'R' THEN 'Laboratory' END AS component,
  l_linestatus = 'F' AS is_primary, l_quantity::INT AS seat_capacity,
  CASE WHEN l_tax < 0.02 THEN ' imperial  valley' WHEN l_tax < 0.06 THEN 'Main  San Diego site'
       ELSE ' Global  Campus ' END AS campus,
  CASE WHEN l_linenumber <> 5 THEN round(l_discount * 50, 1) END AS class_difficulty,
  CASE WHEN l_linenumber <> 7 THEN 'Room ' || (l_suppkey % 30) END AS location,
  'https://classes.example.edu/s/' || l_suppkey AS source_url,
  {_term('o_orderdate')} AS term, {_code('o_orderdate')} AS term_code,
  coalesce(nullif({_code('o_orderdate')}, ''), {_term('o_orderdate')}) AS term_key,
  coalesce(nullif({_code('o_orderdate')}, ''), {_term('o_orderdate')}) || '|' || l_suppkey || '-' || l_quantity::INT AS physical,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'in_person' WHEN '2-HIGH' THEN 'online_synchronous'
    WHEN '3-MEDIUM' THEN 'hybrid' WHEN '4-NOT SPECIFIED' THEN 'online_asynchronous' ELSE 'other' END AS instruction_mode,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'waitlist' WHEN 'F' THEN 'closed' END AS seat_status,
  CASE o_orderstatus WHEN 'O' THEN greatest(l_quantity::INT - l_linenumber, 1) WHEN 'F' THEN 0 END AS seats_available,
  CASE WHEN o_orderpriority <> '5-LOW' THEN l_linenumber END AS option_number,
  p_brand AS subject, p_size || CASE WHEN l_returnflag = 'R' THEN 'L' ELSE '' END AS catalog_number,
  p_brand || ' ' || p_size || CASE WHEN l_returnflag = 'R' THEN 'L' ELSE '' END AS course_code,
  p_name AS title, CASE WHEN p_size <> 13 THEN p_partkey::VARCHAR END AS crse_id,
  CASE WHEN p_size < 40 THEN 'UGRD' ELSE 'GRAD' END AS career,
  (p_size % 4)::DOUBLE AS units, CASE WHEN l_linenumber <> 6 THEN (p_size % 4)::DOUBLE END AS units_min,
  CASE WHEN l_linenumber <> 6 THEN (p_size % 4 + l_linenumber % 3)::DOUBLE END AS units_max,
  CASE WHEN l_linenumber % 3 = 0 THEN (p_size % 4) || '.00'
       ELSE (p_size % 4) || '.00 - ' || (p_size % 4 + l_linenumber % 3) || '.00' END AS units_text,
  ['letter','credit_no_credit','letter_or_credit_no_credit','other'][p_size % 4 + 1] AS grading,
  CASE WHEN p_size % 5 <> 0 THEN 'About ' || p_type END AS description,
  {_TAGS}[p_size % 8 + 1] AS own_tag, CASE WHEN l_returnflag = 'R' THEN '5C Laboratory' END AS lab_tag,
  CASE WHEN s_suppkey % 10 = 3 THEN 'To Be Announced' WHEN s_suppkey % 10 <> 4 THEN s_name END AS instructor,
  s_suppkey % 10 <> 0 AS has_metrics,
  CASE WHEN s_suppkey % 10 <> 0 THEN round(1 + (s_suppkey % 41) / 10, 1) END AS rating,
  CASE WHEN s_suppkey % 10 <> 0 THEN round(1 + (s_suppkey % 9) / 2, 1) END AS difficulty,
  CASE WHEN s_suppkey % 10 <> 0 THEN (s_suppkey * 7 % 101)::DOUBLE END AS again,
  CASE WHEN s_suppkey % 10 <> 0 THEN (s_suppkey % 60)::INT END AS reviews,
  CASE WHEN s_suppkey % 10 <> 0 THEN CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS attendance,
  CASE WHEN s_suppkey % 10 <> 0 THEN CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false END END AS textbook
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN part p ON l_partkey = p_partkey
JOIN supplier s ON l_suppkey = s_suppkey""",
    # one row per meeting and day
    "meet": """
SELECT listing_id, no, day, 480 + 30 * (l_partkey % 20) + plus AS s,
  480 + 30 * (l_partkey % 20) + 50 + 25 * (l_suppkey % 4) + plus AS e, location,
  l_shipdate::DATE AS date_from, l_shipdate::DATE + 90 AS date_to
FROM (SELECT *, 1 AS no, lower(strftime(l_shipdate, '%a')) AS day, CASE WHEN l_linenumber <> 6 THEN 0 END AS plus
      FROM lst WHERE l_linenumber <> 7
      UNION ALL SELECT *, 2, 'fri', 60 FROM lst WHERE l_linenumber = 2)""",
    "reqtag": """
SELECT listing_id, own_tag AS tag FROM lst UNION ALL SELECT listing_id, lab_tag FROM lst WHERE lab_tag IS NOT NULL""",
    "progtag": f"""
SELECT listing_id, p_type AS program, '2026-2027' AS year, {_CLASSES}[p_size % 3 + 1] AS classification FROM lst
UNION ALL SELECT listing_id, subject, '2025-2026', 'elective' FROM lst WHERE l_linenumber % 2 = 0""",
    "bridge": """
SELECT listing_id, term, course_code, component, section_number, schedule_number, option_number, units, kind, idx, prim,
  component IN ('Activity', 'Laboratory') AS sec,
  CASE component WHEN 'Lecture' THEN 0 WHEN 'Activity' THEN 3 ELSE 4 END AS crank,
  CASE kind WHEN 'signature' THEN 'signature|' || lower(term) || '|' || upper(course_code) || '|' || sig
    WHEN 'row' THEN 'row|' || lower(term) || '|' || l_orderkey || '|' || idx
    WHEN 'single' THEN 'single|' || listing_id
    ELSE 'legacy|' || term_key || '|' || subject || '|' || coalesce(crse_id, course_code) || '|' || offer || '|' || career
         || '|' || option_number END AS key
FROM (
 SELECT *, 'signature' AS kind, NULL::INT AS idx, is_primary AS prim, 'S1' AS sig FROM lst WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT *, 'signature', NULL, is_primary, 'S2' FROM lst WHERE o_orderpriority = '1-URGENT' AND l_linenumber % 2 = 1
 UNION ALL SELECT *, 'row', 1, is_primary, NULL FROM lst WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND l_linenumber < 5
 UNION ALL SELECT *, 'row', 2, is_primary, NULL FROM lst WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND (l_linenumber >= 5 OR l_linenumber = 1)
 UNION ALL SELECT *, 'single', NULL, l_returnflag = 'N', NULL FROM lst WHERE o_orderpriority = '5-LOW'
 UNION ALL SELECT *, 'legacy', NULL, l_returnflag = 'N', NULL FROM lst WHERE o_orderpriority = '4-NOT SPECIFIED')""",
    "rowgrp": """
SELECT key, idx, bool_or(prim) AS has_primary, arg_min(lower(term), listing_id) AS t, arg_min(upper(course_code), listing_id) AS cc
FROM bridge WHERE kind = 'row' GROUP BY key, idx""",
    "moved": """
SELECT g.key, x.target FROM rowgrp g JOIN (SELECT idx, t, cc, min(key) AS target FROM rowgrp WHERE has_primary
  GROUP BY idx, t, cc HAVING count(*) = 1) x ON g.idx = x.idx AND g.t = x.t AND g.cc = x.cc WHERE NOT g.has_primary""",
    "bridged": """
SELECT b.* REPLACE (coalesce(m.target, b.key) AS key) FROM bridge b LEFT JOIN moved m ON b.key = m.key""",
    "ranked_members": """
SELECT *, row_number() OVER (PARTITION BY key ORDER BY NOT prim, crank, section_number, schedule_number, listing_id) AS rn,
  count(*) OVER (PARTITION BY key) AS n_members, bool_or(prim) OVER (PARTITION BY key) AS has_primary,
  bool_and(sec) OVER (PARTITION BY key) AS all_sec FROM bridged""",
    "opt": """
SELECT key AS option_id, kind, listing_id AS primary_id, CASE WHEN kind = 'row' THEN idx ELSE option_number END AS option_number,
  n_members FROM ranked_members WHERE rn = 1 AND (has_primary OR NOT all_sec)
  AND NOT (kind = 'single' AND sec AND units <= 0)""",
    "memb": """
SELECT r.key AS option_id, r.listing_id, r.prim AS is_primary, r.n_members FROM ranked_members r
JOIN (SELECT option_id FROM opt) o ON o.option_id = r.key""",
    "upd": """
SELECT event_id, ts, user_id, event_type, CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'waitlist'
  WHEN 'purchase' THEN 'closed' WHEN 'signup' THEN 'unknown' WHEN 'error' THEN 'failure' END AS kind,
  value AS seconds, floor(value)::INT AS seats, (props->>'$.k')::INT AS k FROM events""",
    # seat observations, the rules applied to them, and the newest per class
    "obs": """
SELECT event_id, ts, user_id, k, kind AS said, (1996 + event_id % 4) || '4|' || user_id || '-' || (k % 50 + 1) AS physical,
  CASE kind WHEN 'open' THEN seats WHEN 'closed' THEN 0 END AS open_seats,
  CASE WHEN kind IN ('open', 'closed') THEN k END AS capacity FROM upd WHERE kind <> 'failure'""",
    "seat": """
SELECT event_id, ts, physical, CASE WHEN open_seats > 0 THEN 'open' ELSE said END AS status, open_seats, capacity,
  CASE WHEN capacity IS NOT NULL AND open_seats IS NOT NULL THEN greatest(capacity - open_seats, 0) END AS enrolled FROM obs
WHERE NOT (said = 'unknown' AND open_seats IS NULL AND capacity IS NULL)""",
    "newest": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY physical ORDER BY ts DESC, event_id DESC) AS rn FROM seat)
WHERE rn = 1""",
    "names": """
SELECT physical, event_id, ts, CASE WHEN k % 5 = 0 THEN 'Staff' ELSE 'Person ' || user_id END AS person FROM obs
QUALIFY row_number() OVER (PARTITION BY physical ORDER BY ts DESC, event_id DESC) = 1""",
    "snap_base": """
SELECT p_brand AS subject, p_size || '-' || p_partkey AS number, p_name AS title,
  CASE WHEN p_size <> 13 THEN p_partkey::VARCHAR END AS crse_id, '1' AS offer,
  CASE WHEN p_size < 40 THEN 'UGRD' ELSE 'GRAD' END AS career, p_partkey::VARCHAR AS class_number,
  p_type AS course_type, p_size % 7 AS section_count, p_size, p_partkey FROM part""",
    "snap_a": "SELECT * FROM snap_base WHERE p_size <> 50",
    "snap_b": """
SELECT * REPLACE (CASE WHEN p_size = 11 THEN 'N' || p_partkey ELSE crse_id END AS crse_id,
  CASE WHEN p_size = 23 THEN '2' ELSE offer END AS offer,
  CASE WHEN p_size = 37 THEN title || ' II' ELSE title END AS title, '9' || class_number AS class_number)
FROM snap_base WHERE p_size <> 47""",
    "prog": f"""
SELECT p_type AS program, '2026-2027' AS year, p_brand AS group_name, p_brand || ' ' || p_size AS course_code,
  {_CLASSES}[p_size % 3 + 1] AS classification,
  CASE WHEN p_size % 17 < 8 THEN {_TAGS}[p_size % 17 + 1] END AS label, 'see ' || p_name AS note, p_partkey
FROM part""",
}


def with_views(body: str) -> str:
    """Prefix the views a query names, so that each oracle is one statement."""
    text = body.strip()
    used: list[str] = []

    def need(sql: str) -> None:
        for name in VIEWS:
            if name not in used and _names(sql, name):
                need(VIEWS[name])
                if name not in used:
                    used.append(name)

    need(text)
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in used)
    if text[:5].upper() == "WITH ":
        text = ("" if not head else ",\n") + text[5:]
        return f"WITH RECURSIVE {head}{text}"
    return f"WITH {head}\n{text}" if head else text


# Natural sort key as a list of structs.
def natural(col: str) -> str:
    return (f"list_transform(regexp_extract_all(lower({col}), '(\\d+|\\D+)'), lambda x: {{"
            "'kind': CASE WHEN regexp_matches(x, '^\\d') THEN 0 ELSE 1 END, "
            "'num': coalesce(TRY_CAST(x AS BIGINT), 0), "
            "'txt': CASE WHEN regexp_matches(x, '^\\d') THEN '' ELSE x END})")


def _names(sql: str, name: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", sql) is not None
