"""All registered queries and their SQL."""

from __future__ import annotations

from sparkloom.queries import ORACLES, QUERIES, call_queries, flow_queries, graph_queries, run_queries, value_queries

flagship = flow_queries.flagship

__all__ = ["ORACLES", "QUERIES", "call_queries", "flagship", "flow_queries", "graph_queries", "run_queries", "value_queries"]
