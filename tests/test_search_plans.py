"""Pages from stored positions, suggestions from ranked grams, conflicts by nodes: against plain Python, with crowds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from offergrid.operators import calendar as C
from offergrid.operators import overlays as O
from offergrid.operators import search as S

OPTION = "option_id string, subject string, catalog_number string, section_number string, option_number int, schedule_number string, rating double, reviews int"


def _plain_order(rows, mode):
    az = sorted(rows, key=lambda r: (r[1], int(r[2]), int(r[3]), r[4] or 0, int(r[5]), r[0]))
    if mode.startswith("alphabetical"):
        return az[::-1] if mode.endswith("desc") else az
    at = 6 if "rating" in mode else 7
    sign = 1 if mode.endswith("asc") else -1
    return sorted(az, key=lambda r: (r[at] is None, sign * (r[at] or 0)))


@pytest.mark.parametrize("mode", ["alphabetical", "alphabetical_desc", "professor_rating", "reviews_asc"])
def test_indexed_pages(spark, mode):
    rng = random.Random(3)
    rows = [(f"o{i:04d}", rng.choice("ab"), str(rng.randint(1, 30)), str(rng.randint(1, 3)), rng.choice((None, 1, 2)), str(rng.randint(1, 9)),
             rng.choice((None, 1.0, 2.5, 4.0)), rng.choice((None, 0, 7))) for i in range(700)]
    index = S.index_orders(S.with_az(spark.createDataFrame(rows, OPTION)), [mode])
    for chosen, number, block in ((rows, 1, 100), (rows, 9, 33), (rows, 10**6, 100), ([r for r in rows if r[1] == "a" and r[7] == 7], 3, 20), ([], 5, 10)):
        ids = spark.createDataFrame([(r[0],) for r in chosen], "option_id string")
        got = S.indexed_page(index.join(ids, "option_id", "left_semi"), mode, number, 20, block=block).collect()
        pages = max(1, -(-len(chosen) // 20))
        at = min(number, pages)
        want = [r[0] for r in _plain_order(chosen, mode)][(at - 1) * 20:at * 20]
        assert [r.option_id for r in sorted(got, key=lambda r: r.pos)] == want
        assert all((r.total, r.pages) == (len(chosen), pages) for r in got)


def _answer(q, lookup, gone, allowed):
    q = q.strip().lower()
    rows = []
    for code, title in lookup:
        c, t = code.lower(), title.lower()
        score = 0 if c.startswith(q) else 1 if t.startswith(q) else 2 if q in c else 3 if q in t else None
        if score is not None and code not in gone and (allowed is None or code in allowed):
            rows.append((score, code))
    return sorted(rows)[:8]


def test_stored_suggestions(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    lookup = sorted({f"{word(2).upper()} {rng.randint(1, 99)}": f"{word(4)} {word(3)}" for _ in range(600)}.items())
    index = O.suggestion_index(spark.createDataFrame(lookup, "code string, title string"))
    asks = ["a", "B", " c ", "1", "ab", "a 1", "abc", "abca", "BC 1", "zz", " ", ""]
    gone = {code for code, _ in rng.sample(lookup, 150)}
    allowed = {code for code, _ in rng.sample(lookup, 60)}
    queries = spark.createDataFrame([(q,) for q in asks], "q string")
    table = lambda codes: spark.createDataFrame([(x.lower(),) for x in codes], "code string")
    for g, a in ((set(), None), (gone, None), (gone, allowed)):
        got = {}
        for r in O.suggest_stored(queries, index, table(g) if g else None, table(a) if a else None).collect():
            got.setdefault(r.q, []).append((r.rank, r.score, r.code))
        want = {q: [(i + 1, s, code) for i, (s, code) in enumerate(_answer(q, lookup, g, a))] for q in asks if q.strip()}
        assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


MEET = "grp long, key long, ord long, day string, start_min int, end_min int, date_from date, date_to date"


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_are_all_pairs(spark, seed):
    import datetime as dt
    rng = random.Random(seed)

    def rows(n, base):
        out = []
        for i in range(n):
            start = rng.choice((None, *range(0, 1440, 7)))
            end = None if start is None else min(1440, start + rng.choice((0, 1, 7, 50, 400)))
            first = rng.choice((None, dt.date(2026, 8, 1), dt.date(2026, 10, 1)))
            out.append((rng.randint(1, 2), base + i // 2, rng.randrange(1000), rng.choice(("mon", "tue")), start, end, first, first and first + dt.timedelta(30)))
        return out

    picked, cands = rows(60, 0), rows(200, 20)
    taken = {(r[0], r[1]) for r in picked}
    want = {}
    for q in cands:
        for p in picked:
            if (q[0], q[1]) in taken or q[0] != p[0] or q[3] != p[3] or None in (q[4], p[4]):
                continue
            if q[4] < p[5] and p[4] < q[5] and (None in (q[6], p[7]) or q[6] <= p[7]) and (None in (p[6], q[7]) or p[6] <= q[7]):
                key = (q[0], q[1])
                want[key] = min(want.get(key, (10**9, 0)), (p[2], p[1]))
    got = C.schedule_conflicts(spark.createDataFrame(picked, MEET), spark.createDataFrame(cands, MEET))
    assert {(r.grp, r.key): r.conflict_with for r in got.collect()} == {k: v[1] for k, v in want.items()} and want


def test_conflicts_of_a_crowded_hour(spark):
    """100,000 picks and as many candidates in one group, day and hour, all with intervals or dates of their own."""
    def crowd(base):
        i = F.col("id")
        start = (600 + i % 30).cast("int")
        return spark.range(100_000).select(F.lit(1).cast("long").alias("grp"), (i + base).alias("key"), i.alias("ord"), F.lit("mon").alias("day"),
                                           start.alias("start_min"), (start + 1 + (i / 30 % 29).cast("int")).alias("end_min"),
                                           F.date_add(F.lit("2026-01-01").cast("date"), (i % 7).cast("int")).alias("date_from"),
                                           F.date_add(F.lit("2026-03-01").cast("date"), (i % 5).cast("int")).alias("date_to"))

    begin = time.time()
    got = C.schedule_conflicts(crowd(0), crowd(10**6)).agg(F.count("*"), F.max("conflict_with")).first()
    assert got[0] == 100_000 and got[1] < 1000 and time.time() - begin < 240


def test_neither_the_a_to_z_key_nor_the_rule_columns_are_stored(spark, monkeypatch):
    from offergrid.operators import options, ordering
    from tests.test_removal import SCHEMA, listings_of
    seen = []

    def noted(settled):
        def note(df):
            seen.append(df)
            return settled(df)
        return note

    monkeypatch.setattr(options, "settled", noted(options.settled))
    monkeypatch.setattr(ordering, "settled", noted(ordering.settled))
    rows = spark.createDataFrame(listings_of(4, 200, 30), SCHEMA).withColumn("catalog_number", F.concat(F.lit("1"), "section_number"))
    carried = ["subject", "catalog_number", "section_number", "schedule_number"]
    table = options.stored_options(rows, carried)
    assert "component" not in seen[0].schema["first"].dataType.names and "kind" not in seen[0].columns
    plain = options.group_options(rows).options
    assert sorted(map(tuple, table.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    for mode in ("alphabetical", "alphabetical_desc"):
        seen.clear()
        got = S.sort_options(table, mode, stored=True, shown=["option_id"])
        assert all(not n.startswith("_az") for df in seen for n in df.columns)
        want = [r.option_id for r in S.with_az(table).orderBy(*S.sort_order(mode)).collect()]
        assert [r.option_id for r in got.orderBy("pos").collect()] == want and got.agg(F.max("pos")).first()[0] == len(want)
