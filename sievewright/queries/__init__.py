"""Registered core queries: name to callable, and name to the SQL with the same result."""

from __future__ import annotations

from sievewright.queries import files, reference, reports

_MODULES = (reference, reports, files)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
