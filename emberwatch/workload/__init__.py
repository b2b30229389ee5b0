"""Registered queries over the driver tables and their SQL oracles."""

from emberwatch.workload import alert_queries, event_queries, scan_queries, source_queries  # noqa: F401 - they register their queries
from emberwatch.workload.queries import QUERIES

__all__ = ["QUERIES"]
