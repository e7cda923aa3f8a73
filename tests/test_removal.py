"""Leave-one-out audit against grouping the rest again, and the gate's rules one by one."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from offergrid.operators import options, removal

SCHEMA = ("listing_id string, term string, term_code string, course_code string, subject string, crse_id string, offer string, career string, "
          "component string, section_number string, schedule_number string, option_number int, units double, source_key string, "
          "group_ids array<string>, primary_group_ids array<string>, group_indices array<int>, primary_group_indices array<int>")


def listings_of(seed, n=40, classes=12):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(("signature", "row", "row", "row", "single", "legacy"))
        component = rng.choice(("Lecture", "Activity", "Activity", "Laboratory", None))
        prim = rng.random() < 0.3
        ids = rng.sample(["A", "B"], rng.randint(1, 2)) if kind == "signature" else []
        idx = rng.sample([1, 2], rng.randint(1, 2)) if kind == "row" else []
        rows.append((f"L{i:03d}", rng.choice(("Fall 2026", "fall 2026")), "", rng.choice(("AB 1", "ab 1", "AB 2")), "AB", None, "1", "U", component, str(i),
                     str(rng.randrange(classes)), rng.randint(1, 2) if kind == "legacy" else None, float(rng.randint(0, 1)),
                     rng.choice("pqrs") if kind == "row" else None, ids, ids if prim else [], idx, idx if prim else []))
    return rows


def audit(rows):
    """(unaccounted classes, unaccounted listings) of plain rows, by the grouping rules."""
    sec = lambda r: any(w in (r[8] or "").lower() for w in options.SECONDARY_WORDS)
    groups = defaultdict(list)
    for r in rows:
        if r[14]:
            keys = [(("s", r[1].lower(), r[3].upper(), g), g in r[15]) for g in r[14]]
        elif r[13] and r[16]:
            keys = [(("row", r[1].lower(), r[13], g), g in r[17]) for g in r[16]]
        else:
            keys = [(("one", r[0]) if r[11] is None else ("old", r[1], r[3], r[11]), not sec(r))]
        for k, p in keys:
            groups[k].append((r, p))
    homes = defaultdict(list)
    whose = lambda k: (k[3], min((r[0], r[1].lower(), r[3].upper()) for r, _ in groups[k])[1:])
    for k in groups:
        if k[0] == "row" and any(p for _, p in groups[k]):
            homes[whose(k)].append(k)
    placed = set()
    for k, members in groups.items():
        prim, alone = any(p for _, p in members), k[0] == "one" and sec(members[0][0]) and members[0][0][12] <= 0
        home = k[0] == "row" and not prim and len(homes[whose(k)]) == 1
        if not alone and (prim or home or not all(sec(r) for r, _ in members)):
            placed |= {r[0] for r, _ in members}
    classes = {(r[1], r[10]) for r in rows}
    return len(classes - {(r[1], r[10]) for r in rows if r[0] in placed}), len({r[0] for r in rows} - placed)


@pytest.mark.parametrize("seed", range(5))
def test_impact_is_the_audit_without_the_class(spark, seed):
    rows = listings_of(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    totals = options.coverage_audit(df, options.group_options(df))[0].first()
    before = audit(rows)
    assert (totals["unaccounted"], totals["listings"] - totals["represented"]) == before
    got = {r.physical: (r.orphaned_classes, r.orphaned_listings) for r in removal.removal_impact(df).collect()}
    want = {}
    for key in {(r[1], r[10]) for r in rows}:
        rest = audit([r for r in rows if (r[1], r[10]) != key])
        want["|".join(key)] = (rest[0] - before[0], rest[1] - before[1])
    assert got == want and any(x != (0, 0) for x in want.values())


def test_gate_rules(spark):
    t = lambda h: dt.datetime(2026, 9, 1) + dt.timedelta(hours=h)

    def row(i, number, code="AB 1", seat=0, group=None, prim=False, component="Lecture"):
        ids = [group] if group else []
        return (f"L{i}", "Fall 2026", "", code, "AB", None, "1", "U", component, "1", number, None, 3.0, None, ids, ids if prim else [], [], [], seat)

    rows = [row(1, "ok"), row(2, "cross"), row(3, "cross", "AB 2"), row(4, "young", seat=90), row(5, "lead", group="G", prim=True),
            row(6, "lab", group="G", component="Laboratory"), row(7, "old"), row(8, "ids"), row(9, "seats"), row(10, "never")]
    df = spark.createDataFrame([(*r[:-1], t(r[-1])) for r in rows], SCHEMA + ", seat_updated_at timestamp")
    then = df.filter("listing_id <> 'L8'").unionByName(df.filter("listing_id = 'L8'").withColumn("listing_id", F.lit("L8x"))).withColumn(
        "seat_updated_at", F.when(F.col("listing_id") == "L9", F.lit(t(1))).otherwise(F.col("seat_updated_at")))
    said = spark.createDataFrame([("old", 90.0), *[(k, 99.5) for k in ("ok", "cross", "young", "lead", "lab", "ids", "seats", "never")]], "k string, h double")
    verdicts = said.join(removal.class_evidence(then), F.concat(F.lit("Fall 2026|"), "k") == F.col("physical")).select(
        "physical", (F.lit(t(0)).cast("double") + F.col("h") * 3600).cast("timestamp").alias("ts"), F.lit(1).alias("event_id"),
        F.when(F.col("k") == "never", "absent_once").otherwise("confirmed_missing").alias("verdict"), "ids", "seat_times")
    got = {r.physical.split("|")[1]: r.reason for r in removal.hide_gate(verdicts, df, F.lit(t(100))).collect()}
    assert got == {"ok": "none", "cross": "crosslisted", "young": "recent_seats", "lead": "orphans", "lab": "none", "old": "expired", "ids": "ids_changed",
                   "seats": "seats_changed", "never": "not_confirmed"}


@pytest.mark.parametrize("seed", range(5, 8))
def test_keys_too_large_for_a_task_give_the_same(spark, seed):
    df = spark.createDataFrame(listings_of(seed, 300, 60), SCHEMA)
    local, joined = (sorted(map(tuple, removal.removal_impact(df, *hot).collect())) for hot in ((), (0,)))
    assert local == joined and any(r[1:] != (0, 0) for r in local)


def tallied(spark, df):
    """``df`` and a counter of the rows that were read of it."""
    reads = spark.sparkContext.accumulator(0)

    def tally(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return df.mapInArrow(tally, df.schema), reads


def test_listings_are_read_once_for_the_impact_and_twice_for_the_gate(spark):
    rows = listings_of(3)
    df, reads = tallied(spark, spark.createDataFrame(rows, SCHEMA))
    removal.removal_impact(df).collect()
    assert reads.value == len(rows)
    timed = spark.createDataFrame(rows, SCHEMA).withColumn("seat_updated_at", F.lit(dt.datetime(2026, 9, 1)))
    verdicts = removal.class_evidence(timed).select("physical", F.lit(dt.datetime(2026, 9, 5)).alias("ts"), F.lit(1).alias("event_id"),
                                                    F.lit("confirmed_missing").alias("verdict"), "ids", "seat_times")
    df, reads = tallied(spark, timed)
    got = removal.hide_gate(verdicts.localCheckpoint(), df, F.lit(dt.datetime(2026, 9, 5))).collect()
    assert got and reads.value == 2 * len(rows)


def test_cross_listing_counts_courses_and_not_nulls(spark):
    rows = [("L1", "a", "AB 1", None), ("L2", "a", "AB 1", ""), ("L3", "b", "AB 1", "7"), ("L4", "b", "AB 1", None), ("L5", "c", None, "7"), ("L6", "c", "AB 1", "7"),
            ("L7", "d", None, None)]
    df = spark.createDataFrame(rows, "listing_id string, schedule_number string, course_code string, crse_id string").withColumns(
        {"term": F.lit("Fall 2026"), "term_code": F.lit(""), "seat_updated_at": F.lit(None).cast("timestamp")})
    assert {r.physical[-1]: r.crosslisted for r in removal.class_evidence(df).collect()} == {"a": False, "b": True, "c": False, "d": False}
