"""Registered queries over the driver tables."""

from vestige.workload import graph_queries, policy_queries, score_queries, source_queries, time_queries  # noqa: F401
from vestige.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
