"""All queries of this package and their SQL."""

from __future__ import annotations

from tessera.llm.queries import QUERIES
from tessera.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
