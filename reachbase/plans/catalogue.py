"""All queries of the engine by name, and their DuckDB forms."""

from __future__ import annotations

from reachbase.plans import access_queries, cause_queries, evidence_queries, history_queries, lookup_queries, report_queries, review_queries, risk_queries

_PARTS = (access_queries, history_queries, risk_queries, report_queries, cause_queries, review_queries, lookup_queries, evidence_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
