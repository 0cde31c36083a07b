"""All registered queries of the core."""

from __future__ import annotations

from . import intervals, reference

_MODULES = (reference, intervals)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
