"""Keys as they are compared, and rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every character with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: str | Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.btrim(col(c).cast("string"), F.lit(WHITE_SPACE))


def norm(c: str | Column) -> Column:
    """The form in which keys are compared: stripped, upper case. Null stays null."""
    return F.upper(strip(c))


def key_or_null(c: str | Column) -> Column:
    """norm(c) where it is a key, i.e. holds a digit; null for null, blank and stand-ins ("unknown", "-", "n/a")."""
    k = norm(c)
    return F.when(k.rlike("[0-9]"), k)


def earliest(df: DataFrame, key: str, columns: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per key, with its earliest `at` and the columns of that delivery.

    Aggregates on the map side first, so a key that was delivered a million times moves as few rows as there are map
    tasks. Rows whose key is null are dropped. Where several deliveries share the earliest time, the least content wins;
    a null time is later than any.
    """
    rest = [c for c in columns if c not in (key, at)]
    picked = F.min(F.struct(F.col(at).isNull().alias("_n"), F.col(at).alias("_at"), *[F.col(c) for c in rest])).alias("_row")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(picked)
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_row._at").alias(at))
    )
