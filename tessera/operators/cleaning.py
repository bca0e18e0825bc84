"""Cleaning as lists of rules, and joins along the catalog's references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import key_or_null
from tessera.sources.catalog import CATALOG

Rule = tuple[str, Column]


def first_reason(rules: list[Rule]) -> Column:
    """The name of the first rule that a row breaks, null if it keeps all; a rule whose condition is null is broken."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def with_parent(child: DataFrame, column: str, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds flag: whether a parent row has the reference's key (as keys are compared). Never multiplies rows."""
    keys = parent.select(key_or_null(key).alias("_k")).where("_k is not null").distinct().withColumn(flag, F.lit(True))
    return child.withColumn("_k", key_or_null(column)).join(keys, "_k", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_k")


def prefixed_join(left: DataFrame, column: str, right: DataFrame, key: str, prefix: str) -> DataFrame:
    """Left join with the right columns as <prefix>__<name>; keys compared as text. A right key that repeats multiplies rows."""
    r = right.select(*[F.col(c).alias(f"{prefix}__{c}") for c in right.columns])
    return left.join(r, F.col(column).cast("string") == F.col(f"{prefix}__{key}").cast("string"), "left")


def relationships(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Per reference of the named tables: child, column_name, parent, rows, referring (with a key), matched."""
    out = []
    for n in names:
        for column, (parent, key) in CATALOG[n].parents.items():
            j = with_parent(tables[n].select(column), column, tables[parent], key, "hit")
            one = j.agg(F.count("*").alias("rows"), F.count(key_or_null(column)).alias("referring"), F.count_if("hit").alias("matched"))
            out.append(one.select(F.lit(n).alias("child"), F.lit(column).alias("column_name"), F.lit(parent).alias("parent"), "rows", "referring", "matched"))
    return reduce(DataFrame.unionByName, out)


def null_missing(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The child with references that no parent has set to null."""
    return with_parent(child, column, parent, key, "_hit").withColumn(column, F.when(F.col("_hit"), F.col(column))).drop("_hit")


def first_filled(*columns: str) -> Column:
    """The first of the columns that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns])


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, chi2 and Cramér's V of two categories, from the counts of their combinations. Rows with a null are left out."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    pa, pb = n.groupBy(a).agg(F.sum("o").alias("na")), n.groupBy(b).agg(F.sum("o").alias("nb"))
    total = n.agg(F.sum("o").alias("n"))
    # empty combinations add their expected count: sum of (o - e)^2 / e = sum of o^2 / e - n
    chi = n.join(pa, a).join(pb, b).crossJoin(F.broadcast(total)).agg(F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.max("n").alias("n"))
    size = pa.agg(F.count("*").alias("ka")).crossJoin(pb.agg(F.count("*").alias("kb")))
    out = chi.crossJoin(size).withColumn("chi2", F.col("s") - F.col("n"))
    least = F.least("ka", "kb") - 1
    return out.select(F.col("n").cast("bigint").alias("n"), "chi2", F.when(least > 0, F.sqrt(F.greatest("chi2", F.lit(0.0)) / (F.col("n") * least))).alias("v"))
