"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_RUNS`` (default 5): each query runs once unmeasured; ``queries`` holds the
median of the runs and ``p95`` the nearest-rank 95th percentile.  Results go to Spark's ``noop`` sink, so every row and column
is worked out but none is sent to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from offergrid.operators import options, search
from offergrid.plans import QUERIES
from offergrid.plans.bindings import Views
from offergrid.plans.searching import FLAGSHIP
from offergrid.session import build_session

HEADLINE = (
    "g3_search", "e7_group_options", "e6_coverage_audit", "c11_batch_search", "c4_where_text", "d4_overlay_seats",
    "d1_overlay_tags", "d7_schedule_conflicts", "d8_match_people", "d11_snapshot_diff", "e3_facet_counts_excluding",
    "e9_course_rollup", "e15_fold_csv_rows", "e16_collapse_duplicate_offers", "f6_failure_streaks", "g4_canonical_order",
    "k3_page_records", "m2_meeting_recurrence",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus), {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    def stored_search():
        """The flagship search over options stored beforehand; ``g3_search`` also builds and stores them."""
        listings = Views(spark, sf_dir).listings()
        stored = search.publish_options(listings, options.group_options(listings))
        return lambda *_: search.search(listings, stored, FLAGSHIP)

    made = {"g3_search_stored": stored_search()} if not sys.argv[1:] else {}
    names = [*made, *names]

    def once(name: str) -> float:
        begin = time.perf_counter()
        (made.get(name) or QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    times, high = {}, {}
    for name in names:
        once(name)
        taken = sorted(once(name) for _ in range(runs))
        times[name] = round(statistics.median(taken), 3)
        high[name] = round(taken[-(-95 * runs // 100) - 1], 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "p95": high, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
