"""The query catalogue: Spark queries and the SQL with the same results."""

from __future__ import annotations

from . import join_queries, source_queries, stat_queries, text_queries, xml_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (text_queries, stat_queries, join_queries, xml_queries, source_queries):
    QUERIES |= _m.C.queries
    SQL |= _m.C.sql
