"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.keys import col


def ratio(a: str | Column, b: str | Column, times: float = 1.0) -> Column:
    """times * a / b as double; null where b is null or 0."""
    num, den = col(a).cast("double"), col(b).cast("double")
    return F.when(den != 0, num * F.lit(float(times)) / den)


def pct_change(new: str | Column, old: str | Column) -> Column:
    """Change from old to new in per cent; null where old is null or 0."""
    return ratio(col(new).cast("double") - col(old).cast("double"), old, 100.0)


def r(c: Column, digits: int = 6) -> Column:
    """c as a rounded double without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)
