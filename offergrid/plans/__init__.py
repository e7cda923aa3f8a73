"""All registered queries, one module per group of operators."""

from offergrid.plans import expressions, matching, overlaying, paging, qualities, rolling, search_filters, searching, sequencing, snapshotting, sourcing, streams  # noqa: F401
from offergrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
