"""Spark against DuckDB at sf0.001: one query per kind of plan.

``python -m tests.compare 0.01`` runs all of them.
"""

import pytest

from offergrid.plans import ORACLE, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ("a2_read_schedule_csv", "a5_publish", "b0_standardize", "b8_clean_name", "b14_meeting_text", "c4_where_text",
         "c11_batch_search", "d1_overlay_tags", "d4_overlay_seats", "d5_hide_overlay", "d7_schedule_conflicts",
         "d11_snapshot_diff", "d15_alias_groups", "d17_suggest", "e2_filter_options", "e6_coverage_audit",
         "e7_membership", "e16_collapse_duplicate_offers", "e21_profile_progress", "f5_heading_context",
         "f6_failure_streaks", "f8_refresh_queue", "g1_sort_professor_rating", "g3_search", "h4_replace_keys",
         "i7_interest_sessions", "i9_late_data", "k3_page_records", "k7_best_link", "m2_meeting_occurrences",
         "m4_accept_schedule")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    ok, message, _ = compare(spark, duck, SF, name, QUERIES[name], ORACLE[name])
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
