"""Changes in place: audits as differences, touched files only, refusal, upserts with bounded files."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from offergrid.operators import lifecycle as H
from offergrid.session import new_folder
from offergrid.sources import partitions as P
from offergrid.sources import pointers
from offergrid.streaming import runs as R
from offergrid.streaming import upserts as U
from tests.test_removal import SCHEMA, audit, listings_of


def _counts(rows):
    classes, listings = audit(rows)
    return {"listings": len(rows), "physical": len({(r[1], r[10]) for r in rows}), "unaccounted": classes, "unlisted": listings}


@pytest.mark.parametrize("seed", range(4))
def test_audit_delta_is_the_difference_of_two_audits(spark, seed):
    rng = random.Random(seed)
    rows = listings_of(seed, 60, 14)
    gone = rng.sample(rows, 6)
    come = [(f"N{i}", *r[1:]) for i, r in enumerate(rng.sample(listings_of(seed + 50, 40, 14), 7))] + [gone[0]]
    rest = [r for r in rows if r not in gone] + come
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.audit_delta(df, spark.createDataFrame(gone, SCHEMA), spark.createDataFrame(come, SCHEMA)).first().asDict()
    before, after = _counts(rows), _counts(rest)
    assert {k: got[k] for k in before} == {k: after[k] - before[k] for k in before}
    whole = [H.audit_counts(spark.createDataFrame(x, SCHEMA)).first() for x in (rows, rest)]
    assert got == {k: whole[1][k] - whole[0][k] for k in H.AUDIT}


def row(i, term, number, code="AB 1", group=None, prim=False, component="Lecture"):
    ids = [group] if group else []
    return (f"{term[:1]}{term[-1]}{i}", term, "", code, "AB", None, "1", "U", component, "1", number, None, 3.0, None, ids, ids if prim else [], [], [])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("instructor", F.lit("Ann Lee"))


def _files(spark, target):
    return {(str(r.path), r.sha) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(target).select("path", F.sha2("content", 256).alias("sha")).collect()}


def test_terms_are_replaced_in_place(spark):
    target = new_folder(spark, "terms")
    rows = [row(i, term, str(i)) for term in ("Fall 2025", "Spring 2026", "Fall 2026") for i in range(4)]
    H.publish_terms(frame(spark, rows), target)
    before, reader = _files(spark, target), P.read_parts(spark, target)
    new = [row(i, "FALL 2026 ", str(i)) for i in range(2)]
    H.apply_replace_term(spark, target, frame(spark, new))
    table = P.read_parts(spark, target).collect()
    assert {r.listing_id for r in table} == {r[0] for r in rows if r[1] != "Fall 2026"} | {r[0] for r in new}
    assert before <= _files(spark, target)  # no file of the state before was touched
    assert reader.count() == 12  # a reader that had begun still sees the old state
    shown = pointers.newest(spark, target)
    assert sorted(shown["parts"].values()) == [1, 1, 2] and shown["facts"]["audit"]["listings"] == 10
    with pytest.raises(ValueError, match="duplicate id"):
        H.apply_replace_term(spark, target, frame(spark, [row(0, "Fall 2025", "0")[:1] + row(0, "Winter 2027", "0")[1:]]))
    P.roll_back(spark, target)
    assert P.read_parts(spark, target).count() == 12
    P.tidy(spark, target, kept=1)
    assert P.read_parts(spark, target).count() == 12 and len(_files(spark, target)) < len(before) + 2


def test_rotation_is_refused_when_the_audit_fails(spark):
    target = new_folder(spark, "terms")
    H.publish_terms(frame(spark, [row(i, t, str(i)) for t in ("Fall 2025", "Spring 2026") for i in range(3)]), target)
    lost = frame(spark, [row(1, "Fall 2026", "1"), row(2, "Fall 2026", "2", group="G", component="Laboratory")])
    with pytest.raises(H.AuditFailed):
        H.apply_rotation(spark, target, lost, "Fall 2025")
    assert pointers.newest(spark, target)["number"] == 1
    with pytest.raises(ValueError, match="no rows"):
        H.apply_rotation(spark, target, lost, "Fall 1900")
    good = frame(spark, [row(1, "Fall 2026", "1"), row(2, "Fall 2026", "2", group="G", component="Laboratory"), row(3, "Fall 2026", "3", group="G", prim=True)])
    H.apply_rotation(spark, target, good, " fall  2025")
    assert {r.term for r in P.read_parts(spark, target).select("term").distinct().collect()} == {"Spring 2026", "Fall 2026"}
    keys = spark.createDataFrame([("AB|AB 1|1|U",)], "offering string")
    worse = frame(spark, [row(9, "Fall 2026", "2", group="G", component="Laboratory")])
    with pytest.raises(H.AuditFailed):
        H.apply_replace_keys(spark, target, worse, keys, "Fall 2026")
    H.apply_replace_keys(spark, target, frame(spark, [row(9, "Fall 2026", "1")]), keys, "Fall 2026")
    assert P.read_parts(spark, target).filter("term = 'Fall 2026'").count() == 1
    assert pointers.newest(spark, target)["facts"]["audit"] == H.audit_counts(P.read_parts(spark, target)).first().asDict()


SEATS = "physical string, event_id long, status string, ts timestamp"


def _flush(i):
    t = lambda s: dt.datetime(2026, 9, 1) + dt.timedelta(seconds=s)
    rng = random.Random(i)
    return [(f"c{rng.randrange(30)}", i * 10 + j, rng.choice(("open", "closed")), t(rng.randrange(1000))) for j in range(10)]


def _want(rows):
    best = {}
    for r in rows:
        if r[0] not in best or (r[3], r[1]) > best[r[0]]:
            best[r[0]] = (r[3], r[1])
    return {k: v[1] for k, v in best.items()}


def test_files_stay_bounded_over_fifty_flushes(spark):
    out, rows, most = new_folder(spark, "seats"), [], 0
    each = U.upsert_writer(out, "physical", ("ts", "event_id"), buckets=2, compact=4)
    for i in range(50):
        rows += _flush(i)
        each(spark.createDataFrame(_flush(i), SEATS).coalesce(1), i)
        if i % 10 == 7:
            each(spark.createDataFrame(_flush(i), SEATS), i)  # the same batch again
        most = max(most, len(_files(spark, out)))
    got = U.read_upserted(spark, out)
    assert {r.physical: r.event_id for r in got.collect()} == _want(rows) and got.count() == len(_want(rows))
    assert most <= 2 * (2 * 4 + 4) and len(pointers.names_in(spark, f"{out}/_pointers")) <= 5


def test_a_reader_sees_whole_flushes_only(spark):
    out = new_folder(spark, "seats")
    each = U.upsert_writer(out, "physical", ("ts", "event_id"), buckets=2)
    each(spark.createDataFrame(_flush(0), SEATS), 0)
    before = U.read_upserted(spark, out).count()
    U._write(spark.createDataFrame(_flush(1), SEATS), out, "physical", 2)  # a flush that died before its pointer
    jvm, at, fs = pointers._store(spark, f"{out}/_pointers/{2:012d}.json")
    half = fs.create(at, False)
    half.write(bytearray(b'{"base": {'))
    half.close()
    assert U.read_upserted(spark, out).count() == before
    each(spark.createDataFrame(_flush(1), SEATS), 1)
    assert {r.physical: r.event_id for r in U.read_upserted(spark, out).collect()} == _want(_flush(0) + _flush(1))


def test_follow_flushes_and_goes_on_after_a_restart(spark, tmp_path):
    out, rows = new_folder(spark, "seats"), []
    each = U.upsert_writer(out, "physical", ("ts", "event_id"), buckets=2)
    for i in range(2):
        rows += _flush(i)
        spark.createDataFrame(_flush(i), SEATS).coalesce(1).write.parquet(f"{tmp_path}/in/slice={i}")
        stream = R.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SEATS).schema)
        q = R.follow(stream, each, f"{tmp_path}/checkpoint", every="200 milliseconds")
        try:
            end = time.time() + 60
            while (pointers.newest(spark, out) or {"batch": -1})["batch"] < i and time.time() < end:
                time.sleep(0.2)
        finally:
            q.stop()
        assert {r.physical: r.event_id for r in U.read_upserted(spark, out).collect()} == _want(rows)
