"""Findings of the third round: each test failed before its change."""

from __future__ import annotations

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from offergrid.operators import options as O
from offergrid.operators import overlays
from offergrid.operators import search as S
from offergrid.operators.ordering import ranked
from offergrid.plans import ORACLE, QUERIES
from offergrid.plans.bindings import Views
from offergrid.streaming import stateful as T

SMALL = "/root/testdata/sf0.001"
METRICS = "struct<rating:double,difficulty:double,again:double,reviews:int,attendance:boolean,textbook:boolean>"


def test_ranked_reads_its_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def met(x):
        seen.add(1)
        return x * 7919 % 1000

    out = ranked(spark.range(0, 1000, 1, 4).select(met("id").alias("x")), [F.col("x").asc()], chunk_rows=100)
    assert {(r.x, r.pos) for r in out.collect()} == {(i, i + 1) for i in range(1000)}
    assert seen.value == 1000


def test_stored_options_are_those_of_the_plain_grouping(spark):
    lst = Views(spark, SMALL).listings()
    plain = O.group_options(lst)
    assert O.alias_groups(O.option_bridge(lst)).count() > 0
    names = ["subject", "section_number", "class_difficulty"]
    want = S.option_rows(lst.select("listing_id", *names), plain.options)
    got = O.stored_options(lst, names)
    columns = ["option_id", "kind", "primary_id", "option_number", "n_members", *names]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_inventory_keeps_no_python_state(spark):
    schema = "source long, grid long, complete boolean, right_term boolean, says_empty boolean, numbers array<string>"
    grids = spark.createDataFrame([(1, 1, True, True, False, ["a", "x"]), (1, 2, True, None, False, ["b"]), (2, 1, True, True, True, None)], schema)
    out = T.inventory_stream(grids, spark.createDataFrame([(1, "a"), (1, "b")], "source long, number string"))
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert {tuple(map(str, r)) for r in out.collect()} == {("1", "2", "untrusted", "['b']", "['x']"), ("2", "1", "unverified", "[]", "[]")}


def test_a_rating_that_says_the_same_is_still_a_hit(spark):
    same = (4.0, 2.0, 50.0, 7, None, None)
    listings = spark.createDataFrame([("1", "Ann Lee", same), ("2", "Bo Day", same)], f"listing_id string, instructor string, metrics {METRICS}")
    rated = spark.createDataFrame([("Lee, Ann", same)], f"name string, metrics {METRICS}")
    got = {r.listing_id: r.changed for r in overlays.overlay_metrics(listings, rated).collect()}
    assert got == {"1": True, "2": False}


def test_sessions_that_end_in_the_second_of_the_watermark(spark, tmp_path):
    def at(hours: float, micros: int = 0) -> dt.datetime:
        return dt.datetime(2026, 9, 1) + dt.timedelta(hours=hours, microseconds=micros)

    rows = [(1, at(0, 400_000), 1), (2, at(1), 2), (3, at(5, 200_000), 3), (4, at(-9), 4), (5, at(-5), 4), (6, at(-5), 5), (7, at(0, 1_300_000), 6)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', 1.5, '{\"k\": 3}')", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    name = "i7_interest_sessions_stream"
    out = QUERIES[name](spark, str(tmp_path))
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(cur.fetchall())
    assert out.count() == 4


def test_search_reads_what_the_plain_publication_holds(spark):
    lst = Views(spark, SMALL).listings()
    plain, made = S.publish_options(lst, O.group_options(lst)), S.publish_grouping(lst)
    for a, b in ((plain.options, made.options), (plain.membership, made.membership)):
        assert sorted(a.columns) == sorted(b.columns)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def _lineitem_reads(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_saved_options_read_stored_members(spark):
    assert _lineitem_reads(QUERIES["m3_saved_options"](spark, SMALL)) == 0


def test_listings_are_stored_compressed(spark):
    from pathlib import Path
    from offergrid.session import shared_root

    root = Path(shared_root(spark)) / "offergrid"
    before = set(root.glob("listings-json-*"))
    QUERIES["a1_read_listings"](spark, SMALL)
    files = [f.name for folder in set(root.glob("listings-json-*")) - before for f in folder.glob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_requests_are_checked_in_one_pass_over_the_listings(spark):
    assert _lineitem_reads(QUERIES["j3_invariants"](spark, SMALL)) <= 2


def test_dates_of_a_listing_given_twice_count_it_once(spark):
    from offergrid.operators import calendar as C

    day = dt.date(2026, 9, 7)
    one = [(["mon", "wed"], 60, 110, day, dt.date(2026, 9, 15)), (["mon"], 200, 250, day, dt.date(2026, 9, 8)), (["tue"], None, None, day, day)]
    df = spark.createDataFrame([("a", one), ("a", one[:1]), ("b", one[1:]), ("c", [])], "listing_id string, meetings array<struct<days:"
                               "array<string>,start_min:int,end_min:int,date_from:date,date_to:date>>")
    got = {str(r.date): (r.n, r.listings) for r in C.occurrences_per_date(df).collect()}
    assert got == {"2026-09-07": (4, 2), "2026-09-09": (2, 1), "2026-09-14": (2, 1)}


def test_listings_written_by_term_are_small(spark):
    from pathlib import Path
    from offergrid.session import shared_root

    root = Path(shared_root(spark)) / "offergrid"
    before = set(root.glob("listings-parquet-*"))
    QUERIES["a1_read_listings_parquet"](spark, SMALL)
    files = [f.name for folder in set(root.glob("listings-parquet-*")) - before for f in folder.glob("*/part-*")]
    assert files and all(".zstd." in f for f in files)


def test_build_issues_are_stored_step_by_step(spark):
    assert _lineitem_reads(QUERIES["j1_build_issues"](spark, SMALL)) == 0


def test_placement_counts_what_the_plain_audit_counts(spark):
    lst = Views(spark, SMALL).listings()
    for df in (lst, lst.union(lst.filter("seat_status = 'open'").withColumn("component", F.lit("Lecture")))):
        totals, lost = O.coverage_audit(df, O.group_options(df))
        placed = O.placement(df)
        assert placed.moved.count() > 0
        assert O.placement_counts(placed).first() == totals.select(
            "listings", "physical", "options", "unaccounted", F.expr("listings - represented").alias("unlisted")).first()
        assert sorted(O.lost_classes(placed).collect()) == sorted(lost.select("physical").collect())


def test_a_report_without_a_known_audit_groups_nothing_twice(spark, monkeypatch):
    from offergrid.operators import lifecycle as H

    lst = Views(spark, SMALL).listings()
    new = lst.filter("term = 'Fall 1997' AND career = 'GRAD'").withColumn("component", F.lit("Lecture"))
    plan = H.replace_keys(lst, new, new.select(H.offering().alias("offering")), "Fall 1997")
    by_delta = H.replace_keys(lst, new, new.select(H.offering().alias("offering")), "Fall 1997", H.audit_counts(lst)).report.first()
    monkeypatch.setattr(H, "audit_delta", None)
    assert plan.report.first() == by_delta
    assert plan.counts.columns == ["current", "incoming", "preserved", "not_incoming", "unexpected", "not_active"]


def test_only_row_groups_meet_the_moved_ones(spark):
    options, _ = O._grouped(Views(spark, SMALL).listings())
    assert "Union" in options._jdf.queryExecution().optimizedPlan().toString()
