"""Run queries against their DuckDB oracle: ``python -m tests.compare SF [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


LOCAL = {"spark.ui.showConsoleProgress": "false", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        return ("float", round(v, 6) + 0.0)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, str):
        return ("str", v)
    return (type(v).__name__, str(v))


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data), sorted(cols)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    """(ok, message, seconds) for one query."""
    begin = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - begin
    if sql is None:
        return True, f"{len(got)} rows, no oracle", spent
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_raw = cur.fetchall()
    mine, mycols = rows(df.columns, got)
    want, cols = rows(names, want_raw)
    if mycols != cols:
        return False, f"columns {mycols} != {cols}", spent
    if mine != want:
        a, b = set(mine), set(want)
        only_a, only_b = sorted(a - b, key=str)[:3], sorted(b - a, key=str)[:3]
        return False, f"rows {len(mine)} vs {len(want)}; cols {cols}\n   spark {only_a}\n   duck  {only_b}", spent
    return True, f"{len(mine)} rows" + ("" if mine else "  (EMPTY)"), spent


def main(argv):
    import __spark_entry__ as e
    from offergrid.session import build_session
    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = build_session("local[8]", 8, LOCAL)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), []
    qs, oracle = e.queries(), e.oracle_sql()
    names = [n for n in qs if not argv[1:] or any(n == a or n.startswith(a) for a in argv[1:])]
    for name in names:
        try:
            ok, msg, spent = compare(spark, con, sf_dir, name, qs[name], oracle.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on to the next query
            ok, msg, spent = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0.0
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {spent:6.2f}s {msg}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
