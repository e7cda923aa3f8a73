"""State kept over micro-batches: schedules with dates, cooldown timers, inventory evidence."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from offergrid.operators import calendar as C
from offergrid.streaming import runs as R
from offergrid.streaming import stateful as T

ADDS = "grp long, day string, ord long, action string, item long, start_min int, end_min int, date_from date, date_to date"


def replay(spark, tmp_path, slices, schema, build, mode="update"):
    """Rows emitted while the slices arrive one after the other, with a restart between them."""
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/slice={i}")
        stream = R.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        R.run_available(build(stream), R.batch_writer(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", mode)
    return R.read_batches(spark, f"{tmp_path}/out")


def plain_fold(rows):
    """Adds judged by comparing every pair of meetings."""
    out, held = {}, {}
    adds = {}
    for r in rows:
        adds.setdefault((r[0], r[2]), []).append(r)
    for (grp, order), add in sorted(adds.items()):
        item, mine = add[0][4], held.setdefault(grp, {})

        def meet(a, b):
            return (a[1] == b[1] and None not in (a[5], a[6], b[5], b[6]) and a[5] < b[6] and b[5] < a[6]
                    and (a[7] is None or b[8] is None or a[7] <= b[8]) and (b[7] is None or a[8] is None or b[7] <= a[8]))

        if add[0][3] == "remove":
            said = "removed" if mine.pop(item, None) else "not_held"
        elif item in mine:
            said = "duplicate"
        elif any(meet(a, b) for a in add for kept in mine.values() for b in kept):
            said = "conflict"
        else:
            mine[item], said = add, "accepted"
        out[(grp, order)] = said
    return out


def adds_of(seed, n=160):
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = rng.choice((None, *range(480, 900, 15)))
        first = rng.choice((None, dt.date(2026, 8, 1), dt.date(2026, 9, 1), dt.date(2026, 10, 1)))
        common = (rng.choices(("add", "remove"), (4, 1))[0], rng.randrange(25), start, None if start is None else start + rng.choice((10, 50, 300)),
                  first, rng.choice((None, first and first + dt.timedelta(days=rng.choice((5, 40))))))
        grp = rng.randint(1, 2)
        rows += [(grp, day, i, *common) for day in rng.sample(("mon", "tue", "wed"), rng.randint(1, 2))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_schedule_with_dates(spark, seed):
    rows = adds_of(seed)
    got = {(r.grp, r.ord): r.result for r in C.accept_schedule(spark.createDataFrame(rows, ADDS)).collect()}
    assert got == plain_fold(rows) and len(set(got.values())) == 5


def test_disjoint_dates_do_not_conflict(spark):
    d = lambda m: dt.date(2026, m, 1)
    rows = [(1, "mon", 1, "add", 1, 600, 700, d(8), d(9)), (1, "mon", 2, "add", 2, 610, 650, d(10), d(11)), (1, "mon", 3, "add", 3, 610, 650, d(9), d(10)),
            (1, "mon", 4, "add", 4, 640, 660, None, None), (1, "mon", 5, "add", 5, None, None, d(8), d(9)), (1, "mon", 6, "add", 6, 700, 720, d(8), d(9))]
    got = [r.result for r in C.accept_schedule(spark.createDataFrame(rows, ADDS)).orderBy("ord").collect()]
    assert got == ["accepted", "accepted", "conflict", "conflict", "accepted", "accepted"]


def test_schedule_stream_is_the_batch(spark, tmp_path):
    rows = adds_of(9, 90)
    slices = [[r for r in rows if r[2] // 30 == i] for i in range(3)]
    random.Random(1).shuffle(slices[1])
    got = replay(spark, tmp_path, slices, ADDS, C.accept_schedule_stream)
    assert {(r.grp, r.ord): r.result for r in got.collect()} == plain_fold(rows)


TRIES = "source long, event_id long, failure string, ts timestamp"


def test_cooldown_timers(spark, tmp_path):
    """A source comes up when its cooldown is over, not before, and not if a newer attempt came first."""
    t = lambda s: dt.datetime(2026, 9, 1) + dt.timedelta(seconds=s)
    slices = [[(1, 1, "timeout", t(0)), (2, 2, "timeout", t(0)), (3, 3, "mismatch", t(0)), (4, 4, None, t(5))],
              [(2, 5, "timeout", t(50)), (9, 6, None, t(100))], [(9, 7, None, t(200))], [(9, 8, None, t(2000))]]
    out = replay(spark, tmp_path, slices, TRIES, lambda s: T.backoff_stream(s, "source", "10 seconds"))
    due = {(r.source, r.streak, r.retry_at - t(0).replace(tzinfo=dt.timezone.utc).timestamp()): r.batch for r in out.filter("kind = 'due'").collect()}
    assert set(due) == {(1, 1, 60.0), (2, 2, 170.0), (3, 1, 1800.0)}
    assert due[(1, 1, 60.0)] < due[(2, 2, 170.0)] < due[(3, 1, 1800.0)]


def test_cooldown_of_a_hot_source_in_any_row_order(spark, tmp_path):
    """Attempts of one source shuffled over many small Arrow batches, and a streak that goes on over micro-batches."""
    rng = random.Random(2)
    rows = [(1, i, rng.choices((None, "a", "b"), (1, 6, 2))[0] if i < 900 else "a", dt.datetime(2026, 9, 1) + dt.timedelta(seconds=i // 2)) for i in range(1500)]
    slices = [rows[:800], rows[800:1200], rows[1200:]]
    for part in slices:
        rng.shuffle(part)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 37)
    try:
        out = replay(spark, tmp_path, slices, TRIES, lambda s: T.backoff_stream(s, "source", "1 day"))
    finally:
        spark.conf.set(name, before)
    got = R.last_state(out.filter("kind = 'state'").drop("kind"), ["source"]).first()
    run = 0
    for r in reversed(rows):
        if r[2] != "a":
            break
        run += 1
    assert run >= 600 and (got.failure, got.streak) == ("a", run)


def test_inventory_evidence_is_kept(spark, tmp_path):
    """Partial, wrong-term, unrelated and empty grids change the status and never the evidence."""
    schema = "source long, grid long, complete boolean, right_term boolean, says_empty boolean, numbers array<string>"
    ok, slices = (True, True, False), []
    slices.append([(1, 1, *ok, ["a", "b", "x"]), (2, 1, True, True, True, []), (3, 1, False, True, False, ["a"]), (4, 1, *ok, ["z"]), (5, 1, *ok, [])])
    slices.append([(1, 2, False, True, False, ["a"]), (1, 3, True, False, False, ["a", "b", "c"]), (2, 2, *ok, ["a", "b", "c"])])
    slices.append([(1, 4, True, True, True, []), (3, 2, *ok, ["c"])])
    expected = spark.createDataFrame([(s, n) for s in (1, 2, 3, 4, 5) for n in "abc"], "source long, number string")
    out = R.last_state(replay(spark, tmp_path, slices, schema, lambda s: T.inventory_stream(s, expected)), ["source"])
    got = {r.source: (r.grid, r.status, r.missing, r.unlisted) for r in out.collect()}
    assert got == {1: (4, "unverified", ["c"], ["x"]), 2: (2, "trusted", [], []), 3: (2, "trusted", ["a", "b"], []),
                   4: (1, "different", [], []), 5: (1, "untrusted", [], [])}
