"""All queries of the core and their SQL."""

from __future__ import annotations

from tessera.plans import checks, cleaning, planning, problems, quality, sales, temporal

_MODULES = (problems, sales, temporal, quality, cleaning, checks, planning)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
