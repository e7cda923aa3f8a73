"""Semantics on small hand tables, and skewed tables against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from offergrid.functions import labels as L
from offergrid.functions import parsing as P
from offergrid.functions import text as T
from offergrid.operators import filters as X
from offergrid.operators import options as O
from offergrid.operators import pages as K
from offergrid.operators import rollups as R
from offergrid.operators import search as S
from offergrid.operators import sequences as Q
from offergrid.operators.calendar import accept_schedule
from offergrid.operators.invariants import invariants
from offergrid.operators.matching import match_people
from offergrid.operators.ordering import ranked, top_per_key
from offergrid.operators.star import normalise_to_star, sync_tables
from offergrid.session import new_folder
from offergrid.sources import sinks as W
from offergrid.sources.readers import read_listings, resolve_headers

c = F.col


def values(spark, raw, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(c("x"))).collect()]


def test_text_expressions(spark):
    assert values(spark, ["Doe, Jané", "a, b, c", None], T.person_key) == ["jane doe", "a b c", ""]
    assert values(spark, ["STAFF", "To be  announced", "Ann Lee"], T.is_placeholder) == [True, True, False]
    assert values(spark, ["To Be Announced Vi Nair", "A B A B", "Staff"], T.clean_name) == ["Vi Nair", "A B", "Staff"]
    assert values(spark, ["7:05 pm", "19:05", "25:00", "12:00 AM"], P.clock_minutes) == [1145, 1145, None, 0]
    assert [list(v) for v in values(spark, ["MWF", "Tuesday", "TBA", "TR"], P.meeting_days)] == [
        ["mon", "wed", "fri"], ["tue"], [], ["tue", "thu"]]
    assert values(spark, ["GE 3A: arts", "Other", "gwar"], L.requirement_tag) == ["3A Arts", None, "GWAR"]


def test_natural_key_orders_numbers(spark):
    raw = ["100A", "20B", "9", "", "100", "0099", "12345678901234567890123456789012345678901234567890"]
    df = spark.createDataFrame([(x,) for x in raw], "x string").orderBy(T.natural_key(c("x")))
    assert [r[0] for r in df.collect()] == ["", "9", "20B", "0099", "100", "100A", raw[-1]]


def listing(i, **kw):
    base = dict(listing_id=i, term="Fall 2026", term_code="20264", subject="CS", catalog_number="150", course_code="CS 150",
                section_number="01", schedule_number=i, option_number=None, source_key=None, group_indices=[],
                primary_group_indices=[], group_ids=[], primary_group_ids=[], crse_id="1", offer="1", career="UG",
                component="Lecture", title="Intro", units=3.0, units_min=None, units_max=None, instructor="Ann",
                grading="letter", campus="San Diego", seat_status="open", instruction_mode="hybrid",
                class_difficulty=None, requirement_tags=[], program_tags=[], meetings=[], metrics=None)
    return {**base, **kw}


SCHEMA = ("listing_id string, term string, term_code string, subject string, catalog_number string, course_code string, "
          "section_number string, schedule_number string, option_number int, source_key string, group_indices array<int>, "
          "primary_group_indices array<int>, group_ids array<string>, primary_group_ids array<string>, crse_id string, "
          "offer string, career string, component string, title string, units double, units_min double, units_max double, "
          "instructor string, grading string, campus string, seat_status string, instruction_mode string, "
          "class_difficulty double, requirement_tags array<string>, program_tags array<struct<program:string,year:string,"
          "classification:string>>, meetings array<struct<days:array<string>,start_min:int,end_min:int,location:string>>, "
          "metrics struct<rating:double,difficulty:double,again:double,reviews:int,attendance:boolean,textbook:boolean>")


def table(spark, *rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in listing("x")) for r in rows], SCHEMA).select(*names)


def test_grouping_rules(spark):
    rows = [
        listing("lec", source_key="k", group_indices=[1], primary_group_indices=[1]),
        listing("lab", source_key="k", group_indices=[1], component="Laboratory"),
        listing("far", source_key="other", group_indices=[1], component="Activity"),     # joins the one primary group
        listing("lost", source_key="z", group_indices=[9], component="Activity"),        # all secondary: vanishes
        listing("zero", component="Laboratory", units=0.0),                               # lone zero-unit secondary
        listing("alone"),
    ]
    opts = O.group_options(table(spark, *rows))
    got = {r.primary_id: (r.n_members, r.option_number) for r in opts.options.collect()}
    assert got == {"lec": (3, 1), "alone": (1, None)}
    totals, lost = O.coverage_audit(table(spark, *rows), opts)
    row = totals.first()
    assert (row.status, row.unaccounted, row.represented) == ("failed", 2, 4)
    assert {r.physical for r in lost.collect()} == {"20264|lost", "20264|zero"}


def test_alias_is_never_guessed(spark):
    rows = [listing("a", source_key="k1", group_indices=[1], primary_group_indices=[1]),
            listing("b", source_key="k2", group_indices=[1], primary_group_indices=[1]),
            listing("x", source_key="k3", group_indices=[1], component="Lab")]
    assert O.alias_groups(O.option_bridge(table(spark, *rows))).count() == 0


def test_filters(spark):
    m = [(["mon"], 540, 600, "R"), (["fri"], None, None, "R")]
    rows = table(spark, listing("t", meetings=m, units_min=1.0, units_max=4.0), listing("u"),
                 listing("v", course_code="CS 15", title="Databases", metrics=(None, 2.0, None, 0, None, True)))

    def ids(p):
        return {r[0] for r in rows.filter(p).select("listing_id").collect()}

    assert ids(X.where_time(480, 660)) == {"t"} and ids(X.where_time(550, None)) == set()
    assert ids(X.where_days(["fri"])) == {"t"} and ids(X.where_days((), ["mon"])) == {"u", "v"}
    assert ids(X.where_units(3.5, None)) == {"t"} and ids(X.where_units(None, 2)) == {"t"}
    assert ids(X.where_text("cs 15")) == {"t", "u", "v"} and ids(X.where_text('"CS 15" data')) == {"v"}
    assert ids(X.where_metrics(rating_min=0)) == set() and ids(X.where_metrics(textbook=True)) == {"v"}
    assert ids(X.where_metrics(attendance=False)) == set()


def test_null_metrics_are_last_both_ways_and_pages_clamp(spark):
    rows = [listing(x, section_number=n) for x, n in (("a", "2"), ("b", "10"), ("d", "1"))]
    df = table(spark, *rows).withColumns({"option_id": c("listing_id"), "rating": F.when(c("listing_id") == "a", 3.0)
                                         .when(c("listing_id") == "b", 5.0), "n_members": F.lit(1)})
    for mode, want in (("professor_rating", "bad"), ("professor_rating_asc", "abd"), ("alphabetical", "dab"),
                       ("alphabetical_desc", "bad")):
        got = S.sort_options(df, mode).orderBy("pos").collect()
        assert "".join(r.option_id for r in got) == want, mode
    last = S.page(S.with_az(df), S.sort_order("alphabetical"), 99, 2).collect()
    assert [(r.option_id, r.pos, r.total, r.pages) for r in last] == [("b", 3, 3, 2)]
    none = S.page(S.with_az(df.filter("false")), S.sort_order("alphabetical"), 1, 2)
    assert none.count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(1 if i < 700 else i % 40, i, rng.choice([None, None, "a", "b"]), rng.random()) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "k int, i int, v string, x double").repartition(6)


def test_ranked_with_a_hot_key(spark, skewed):
    rows, df = skewed
    got = {(r.k, r.i): r.pos for r in ranked(df, [c("x").asc(), c("i").asc()], by=["k"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[3], r[1])), 1):
            want[(k, r[1])] = n
    assert got == want
    top = top_per_key(df.select("k", "i", "x"), ["k"], [c("x").desc()], 3, salts=4)
    assert {(r.k, r["rank"], r.i) for r in top.collect() if r.k == 1} == {
        (1, n, r[1]) for n, r in enumerate(sorted((r for r in rows if r[0] == 1), key=lambda r: -r[3])[:3], 1)}


def test_sequences_across_blocks(spark, skewed):
    rows, df = skewed
    order = [c("i").asc()]
    fwd = {(r.k, r.i): r.v for r in Q.carry_forward(df, ["k"], order, ["v"], block=16).collect()}
    streak = {(r.k, r.i): r.streak for r in Q.failure_streaks(df, ["k"], order, "v", block=16).collect()}
    mean = {(r.k, r.i): r["mean"] for r in Q.recent_stats(df, ["k"], order, "x", 10, block=16).collect()}
    for k in {r[0] for r in rows}:
        last, run, prev, seen = None, 0, None, []
        for r in sorted(r for r in rows if r[0] == k):
            last = r[2] if r[2] is not None else last
            run = 0 if r[2] is None else run + 1 if r[2] == prev else 1
            prev = r[2]
            seen = (seen + [r[3]])[-10:]
            assert fwd[(k, r[1])] == last and streak[(k, r[1])] == run
            assert mean[(k, r[1])] == pytest.approx(sum(seen) / len(seen))


def test_accept_schedule_in_order(spark):
    adds = [(1, "mon", 1, "add", 7, 600, 660), (1, "mon", 2, "add", 8, 630, 700), (1, "mon", 3, "add", 7, 600, 660),
            (1, "mon", 4, "remove", 7, 600, 660), (1, "mon", 5, "add", 8, 630, 700), (1, "mon", 6, "remove", 9, 0, 1)]
    df = spark.createDataFrame(adds, "grp long, day string, ord long, action string, item long, start_min int, end_min int")
    got = [r.result for r in accept_schedule(df).orderBy("ord").collect()]
    assert got == ["accepted", "conflict", "duplicate", "removed", "accepted", "not_held"]


@pytest.mark.parametrize("rows_a_batch", [1, 10_000])
def test_accept_schedule_takes_an_item_on_all_its_days_or_on_none(spark, rows_a_batch):
    adds = [(1, "mon", 1, "add", 7, 600, 660), (1, "mon", 2, "add", 8, 630, 700), (1, "wed", 2, "add", 8, 630, 700),
            (1, "wed", 3, "add", 9, 630, 700), (1, "fri", 4, "add", 9, 0, 60), (1, "wed", 5, "remove", 9, 630, 700),
            (1, "mon", 6, "remove", 7, 600, 660), (1, "mon", 7, "add", 8, 630, 700), (1, "wed", 7, "add", 8, 630, 700),
            (2, "mon", 1, "add", 8, 630, 700)]
    df = spark.createDataFrame(adds, "grp long, day string, ord long, action string, item long, start_min int, end_min int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = [(r.ord, r.day, r.result) for r in accept_schedule(df).orderBy("grp", "ord", "day").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(1, "mon", "accepted"), (2, "mon", "conflict"), (2, "wed", "conflict"), (3, "wed", "accepted"),
                   (4, "fri", "duplicate"), (5, "wed", "removed"), (6, "mon", "removed"), (7, "mon", "accepted"),
                   (7, "wed", "accepted"), (1, "mon", "accepted")]


def test_match_people_tiers(spark):
    t = spark.createDataFrame([("t1", "Mark Dunster"), ("t2", "Satchithanandam Rao"), ("t3", "Jon Smith")], "target_id string, name string")
    k = spark.createDataFrame([("c1", "Timothy (Mark) Dunster"), ("c2", "Satchi Rao"), ("c3", "Smith, Jon"), ("c4", "Jan Smith"),
                               ("c5", "Mark Other")], "cand_id string, name string")
    got = {(r.target_id, r.cand_id): round(r.score, 2) for r in match_people(t, k).collect()}
    assert got == {("t1", "c1"): 0.98, ("t2", "c2"): 0.94, ("t3", "c3"): 1.0, ("t3", "c4"): 0.88}


def test_publish_and_rollback(spark):
    target = new_folder(spark, "t")
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "listing_id string, term string")
    W.publish(one, target)
    W.publish(one.limit(1), target)
    assert W.read_published(spark, target).count() == 1
    W.rollback(spark, target)
    assert W.read_published(spark, target).count() == 2
    with pytest.raises(ValueError):
        W.rollback(spark, target)  # the first version stands on nothing
    for n in (3, 4):
        W.publish(one.union(one.withColumn("listing_id", F.concat("listing_id", F.lit(str(n))))).limit(n), target)
    W.rollback(spark, target)
    assert W.read_published(spark, target).count() == 3
    W.rollback(spark, target)  # goes on backwards
    assert W.read_published(spark, target).count() == 2
    with pytest.raises(ValueError):
        W.rollback(spark, new_folder(spark, "empty"))


def test_append_by_id(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "listing_id string, term string")
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "listing_id string, term string")
    assert sorted(map(tuple, W.append_by_id(old, new).collect())) == [("a", "x"), ("b", "z"), ("c", "w")]


@pytest.mark.parametrize("shuffles", ["2", "200"])
def test_ranked_chunks_follow_the_rows(spark, shuffles):
    """A hot key spans several chunks, and no chunk holds many more rows than asked for."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        rows = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), F.col("id"))
        out = ranked(rows, [F.col("id").desc()], by=["k"], chunk_rows=500)
        got = {(r["k"], r["id"]): r["pos"] for r in out.collect()}
        assert all(got[0, i] == 3000 - i for i in range(3000)) and all(got[i, i] == 1 for i in range(3000, 4000))
        sizes = [r["count"] for r in spark.read.parquet(*out.inputFiles()).groupBy("_chunk").count().collect()]
        assert sum(sizes) == 4000 and max(sizes) <= 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_overlay_that_does_not_parse(spark, tmp_path):
    (tmp_path / "listings").mkdir()
    (tmp_path / "listings" / "a.json").write_text("")
    for name, text in (("good", '{"records": [{"name": "A", "metrics": {}}]}'), ("bad", '{"records": [{"name": '), ("odd", '{"records": 3}')):
        (tmp_path / f"{name}.json").write_text(text)
        got = read_listings(spark, str(tmp_path / "listings"), overlays={"ratings": str(tmp_path / f"{name}.json")})
        assert [r["overlay"] for r in got.load_errors.collect()] == ([] if name == "good" else ["ratings"])


def test_headers():
    found = resolve_headers(["﻿Class #", "Subject-Code", "Course Number", "Title", "Section", "UNIT"])
    assert found["class_number"] == "﻿Class #" and found["units"] == "UNIT"
    with pytest.raises(ValueError):
        resolve_headers(["Title"])


def test_invariants_see_faults_between_first_and_last_page(spark, monkeypatch):
    rated = [listing(f"o{i}", section_number=str(i), metrics=(float(i), None, None, 0, None, None)) for i in range(10)]
    lst = table(spark, *rated)
    opts = S.publish_options(lst, O.group_options(lst))
    requests = {"all": X.FilterSpec(sort_by="professor_rating"), "down": X.FilterSpec(sort_by="alphabetical_desc"),
                "none": X.FilterSpec(statuses=["no such state"])}

    def failed(o):
        got = invariants(lst, o, requests, F.lit(10), size=3).collect()
        assert len(got) == 6 + 4 * len(requests)
        return {r.name for r in got if r.status == "fail"}

    assert failed(opts) == set()
    real = S.ranked

    def repeats(df, order, *a, **kw):   # the option of place 5 takes that of place 6, too
        rows = real(df, order, *a, **kw)
        five = rows.filter("pos = 5").withColumn("pos", F.lit(6).cast("long"))
        return rows.filter("pos <> 6").unionByName(five)

    monkeypatch.setattr(S, "ranked", repeats)
    assert failed(opts) >= {"pages_add_up_all", "pages_add_up_down"}
    monkeypatch.setattr(S, "ranked", real)
    stale = opts.options.withColumn("rating", F.when(c("option_id").endswith("o5"), 0.5).otherwise(c("rating")))
    assert failed(opts._replace(options=stale)) == {"sort_order_all"}
    other = opts.options.withColumn("primary_id", F.when(c("option_id").endswith("o5"), "o6").otherwise(c("primary_id")))
    assert failed(opts._replace(options=other)) == {"options_recomputed"}


def test_page_records_of_nested_and_open_elements(spark):
    pages = {
        1: "<ul><li>x<ul><li>y</li></ul></li><li>z</li></ul>",
        2: "<div><ul><li>a<li>b &amp; <br>c</ul>tail</div><p>end",
        3: "<div id='box' class=k>one <div>two</div> three</div><div>four</div>",
        4: "<ol><li>p<li>q<ul><li>r</ul><li>s</ol></b> 1-3 of 3",
        5: "<div data-id=box>no</div><DIV ID=box><p>open<div>in</div>",
        6: "<h1>only</h1>",
        7: "<section><li>m</section>after <link>x<table><tr><td><li>n<td>o</table>",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = K.page_records(df, {"box": "#box", "h1": "h1"}, "li", r"^\w").collect()
    lines = {i: [r.text for r in sorted((r for r in got if r.page_id == i and r.kind != "record"), key=lambda r: r.line_no)] for i in pages}
    assert lines == {1: ["x y", "y", "z"], 2: ["a", "b & c"], 3: [], 4: ["p", "q r", "r", "s"], 5: [], 6: [], 7: ["m", "n"]}
    records = {r.page_id: (r.box, r.h1, r.complete) for r in got if r.kind == "record"}
    assert records[3] == ("one two three", None, None) and records[5] == ("open in", None, None)
    assert records[4] == (None, None, True) and records[6] == (None, "only", None)


def test_course_rollup_keeps_prerequisites_and_requirements(spark):
    rows = table(spark, *[listing(x) for x in "abc"], listing("d", course_code="CS 160")).withColumns({
        "description": F.lit(""), "units_text": F.lit(None).cast("string"),
        "prerequisite_text": F.when(c("listing_id") == "c", "Math 1").when(c("listing_id") != "d", " CS 1 "),
        "enrollment_requirements": F.when(c("listing_id") == "a", F.array(F.lit("Major"), F.lit(" Junior ")))
        .when(c("listing_id") == "b", F.array(F.lit("Junior"), F.lit(" ")))})
    got = {r.code: (r.prerequisite_text, r.enrollment_requirements) for r in R.course_rollup(rows).collect()}
    assert got == {"CS 150": ("CS 1", ["Junior", "Major"]), "CS 160": (None, [])}


def test_error_rollup_gives_the_public_code(spark):
    paths = {"/api/Seats/1": "seat_data", "/api/admin/seats": "seat_data", "/x/professors": "professor_ratings", "/api/profile": "catalog_data",
             "/api/classes": "class_results", "/api/options": "filter_options", "/api/admin/x": "admin_data", "/other": "service"}
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ts int")
    got = {r.path: r.public_code for r in R.error_rollup(df, ["path"]).collect()}
    assert got == {p: f"{code}_unavailable" for p, code in paths.items()}


def test_star_has_course_metrics_requirements_and_runs(spark):
    rows = table(spark, listing("a", class_difficulty=2.5, requirement_tags=["GE", "US"]),
                 listing("b", class_difficulty=3.0, requirement_tags=["GE"]), listing("d", catalog_number="160"))
    star = normalise_to_star(rows.withColumns({"seat_capacity": F.lit(1), "seats_available": F.lit(1)}))
    assert [float(r.class_difficulty) for r in star["course_metrics"].collect()] == [2.5]
    assert {r.name for r in star["requirement_definitions"].collect()} == {"GE", "US"}
    runs = spark.createDataFrame([("web", "t1", "done"), ("web", "t2", "failed")], "source_name string, started_at string, status string")
    errors = spark.createDataFrame([("web", s, "Fall", "CS", "timeout", "slow", "t3") for s in ("t2", "t9")],
                                   "source_name string, started_at string, term_name string, subject string, error_type string, "
                                   "message string, occurred_at string")
    got = sync_tables(runs, errors)
    keys = {r.started_at: r.run_key for r in got["sync_runs"].collect()}
    assert [r.run_key for r in got["sync_errors"].collect()] == [keys["t2"]]


def test_audit_gives_every_unaccounted_class(spark):
    lst = table(spark, *[listing(f"x{i:02}", component="Laboratory", units=0.0) for i in range(25)])
    assert O.coverage_audit(lst, O.group_options(lst))[1].count() == 25
