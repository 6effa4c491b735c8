"""All queries and their SQL."""

from __future__ import annotations

from . import artifact_queries, feature_queries, recording_queries, scan_queries, signal_queries, sql_queries, stream_queries

MODULES = [feature_queries, signal_queries, recording_queries, artifact_queries, stream_queries, scan_queries, sql_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
