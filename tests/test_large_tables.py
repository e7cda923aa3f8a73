"""What queries shuffle on large tables: the listings are joined once, and what several steps read is stored."""

import pytest

from offergrid.operators import options as O
from offergrid.operators import overlays
from offergrid.plans import QUERIES
from offergrid.plans.bindings import Views
from offergrid.session import settled
from offergrid.sources import readers as A
from tests.test_removal import SCHEMA, listings_of

SMALL = "/root/testdata/sf0.001"


def _lineitem_reads(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


@pytest.mark.parametrize("name", ["e9_course_rollup", "e10_sitemap_rows"])
def test_course_rollup_reads_stored_options(spark, name):
    assert _lineitem_reads(QUERIES[name](spark, SMALL)) == 0


def test_star_counts_read_stored_listings_and_shuffle_them_once_by_section(spark):
    df = QUERIES["h7_normalise_to_star"](spark, SMALL)
    assert _lineitem_reads(df) == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    # sections, meetings, people and tags of a section: one shuffle by section each
    assert plan.count("Exchange hashpartitioning(section_key") == 4


def test_only_listings_without_a_name_meet_the_names(spark, monkeypatch):
    seen, plain = [], overlays.overlay_instructors

    def note(listings, cache):
        seen.append(sorted((r.listing_id for r in listings.collect())))
        return plain(listings, cache)

    monkeypatch.setattr(overlays, "overlay_instructors", note)
    people = [("a", "Ada One"), ("b", None), ("c", "Staff"), ("d", ""), ("e", "To Be Announced"), ("f", "Bo Two")]
    base = spark.createDataFrame([], A.listing_schema())
    rows = spark.createDataFrame(people, "listing_id string, instructor string").selectExpr(
        "*", "'Fall 2026' AS term", "'20264' AS term_code", "'7' AS schedule_number")
    rows = base.unionByName(rows, allowMissingColumns=True)
    names = spark.createDataFrame([("20264|7", "New  Person", None)], "physical string, instructor string, updated_at timestamp")
    got = {r.listing_id: r.instructor for r in A.lay_over(rows, {"instructor": names}).collect()}
    assert got == {"a": "Ada One", "f": "Bo Two", **dict.fromkeys("bcde", "New Person")}
    assert seen == [["b", "c", "d", "e"]]


def test_audit_reads_stored_listings(spark):
    assert _lineitem_reads(QUERIES["e6_coverage_audit"](spark, SMALL)) == 0


@pytest.mark.parametrize("seed, hot_rows", [(1, O.HOT_ROWS), (2, O.HOT_ROWS), (3, 0), (4, 0)])
def test_members_of_one_shuffle_are_those_of_the_grouping(spark, seed, hot_rows):
    lst = settled(spark.createDataFrame(listings_of(seed, 200, 30), SCHEMA))
    rows = settled(O.option_members(lst, hot_rows=hot_rows))
    opts = O.group_options(lst)
    names = ["option_id", "listing_id", "is_primary", "n_members", "physical"]
    placed = rows.filter("option_id IS NOT NULL")
    assert sorted(map(str, placed.select(*names).collect())) == sorted(map(str, opts.membership.select(*names).collect()))
    want = O.coverage_audit(lst, opts)[0]
    assert O.member_totals(lst, rows).select(*want.columns).collect() == want.collect()


def test_confirmation_state_reads_stored_listings_of_probed_classes(spark, monkeypatch):
    from offergrid.plans import streams

    seen, plain = [], streams.class_evidence
    monkeypatch.setattr(streams, "class_evidence", lambda df: seen.append(df) or plain(df))
    out = QUERIES["i8_confirmation_state"](spark, SMALL)
    assert _lineitem_reads(out) == 0
    probed = {r.physical for r in streams.verdicts(Views(spark, SMALL)).select("physical").distinct().collect()}
    assert {r.physical for r in seen[0].select("physical").distinct().collect()} <= probed
    # rows dealt by class for the seat times are grouped by class as they lie
    plan = plain(seen[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(physical") <= 2


def test_a_table_of_one_class_keeps_it(spark):
    from pyspark.sql import functions as F

    from offergrid.operators import removal
    from offergrid.operators.options import physical

    lst = spark.createDataFrame(listings_of(1, 200, 30), SCHEMA).limit(1).withColumn("seat_updated_at", F.lit(None).cast("timestamp"))
    now = F.lit("2026-09-05 00:00:00").cast("timestamp")
    said = removal.class_evidence(lst).select("physical", now.alias("ts"), F.lit(1).alias("event_id"), F.lit("confirmed_missing").alias("verdict"), "ids", "seat_times")
    given = removal.hide_gate(said, physical(lst), now, impact=removal.removal_impact(lst, stored=True), alone=F.lit(True))
    assert given.collect() == removal.hide_gate(said, lst, now).collect() and given.first().reason == "last_class"


@pytest.mark.parametrize("name", ["m3_saved_options", "j3_recomputed"])
def test_groupings_read_stored_listings(spark, monkeypatch, name):
    reads, plain = [], O.option_bridge
    monkeypatch.setattr(O, "option_bridge", lambda df, *more: reads.append(_lineitem_reads(df)) or plain(df, *more))
    QUERIES[name](spark, SMALL)
    assert reads and not any(reads)
