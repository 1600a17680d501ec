"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import leaks, neardup, packing, pairs, reading, sampling, splits

_MODULES = (sampling, splits, pairs, neardup, packing, leaks, reading)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
