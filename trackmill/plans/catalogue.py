"""Registry of the trajectory queries: name -> DataFrame builder, and name -> SQL oracle."""

from __future__ import annotations

from trackmill.plans import calibration_queries, domain_queries, join_queries, lookup_queries, series_queries, track_queries  # noqa: F401  (they register their queries)
from trackmill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
