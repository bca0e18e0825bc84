"""Typed reading of text files, and safe writing."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.keys import strip
from tessera.session import cut

#: What the name of a column's flag begins with: it said something, but not that.
FLAG = "unread__"
# Notations of dates and times that are tried in order, and words for booleans.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
TIME_FORMATS = ("M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def parse(c: str | Column, kind: T.DataType) -> Column:
    """Text as a value of the type; null where it is blank or can't be read. Never raises."""
    text = F.nullif(strip(c), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)
    if isinstance(kind, T.DateType):
        return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]).cast(kind)
    if isinstance(kind, T.StringType):
        return text
    return text.try_cast(kind)


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """All-text columns as the schema's types, each non-text one with a flag unread__<name>: said something, but not that.

    Missing or unexpected columns raise ValueError with their names.
    """
    missing, extra = set(schema.names) - set(raw.columns), set(raw.columns) - set(schema.names)
    if missing or extra:
        raise ValueError(f"missing columns {sorted(missing)}, unexpected columns {sorted(extra)}")
    values = [parse(f.name, f.dataType).alias(f.name) for f in schema]
    flags = [(F.nullif(strip(f.name), F.lit("")).isNotNull() & parse(f.name, f.dataType).isNull()).alias(FLAG + f.name) for f in schema if not isinstance(f.dataType, T.StringType)]
    return raw.select(*values, *flags)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV files with a header, read as text and typed. Nothing is inferred; files are split by the session's maxPartitionBytes."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return typed(spark.read.schema(text).csv(paths, header=True, encoding="UTF-8", mode="PERMISSIVE", enforceSchema=False), schema)


def source_files(root: str, table: str) -> list[str]:
    """The files of a table: <table>.csv if it exists, else the parts <table>/*.csv and <table>_*.csv in order; root, then root/data."""
    for base in (Path(root), Path(root) / "data"):
        whole = base / f"{table}.csv"
        if whole.exists():
            return [str(whole)]
        parts = sorted([*base.glob(f"{table}/*.csv"), *base.glob(f"{table}_*.csv")])
        if parts:
            return [str(p) for p in parts]
    raise FileNotFoundError(f"no file of {table} below {root}")


def schema_differences(found: T.StructType, wanted: T.StructType) -> dict[str, list]:
    """missing, unexpected and mistyped columns (name, found, wanted)."""
    a, b = {f.name: f.dataType.simpleString() for f in found}, {f.name: f.dataType.simpleString() for f in wanted}
    return {"missing": sorted(b.keys() - a.keys()), "unexpected": sorted(a.keys() - b.keys()), "mistyped": sorted((n, a[n], b[n]) for n in a.keys() & b.keys() if a[n] != b[n])}


def invalid_casts(df: DataFrame) -> DataFrame:
    """column_name, invalid_count for every flag, in one pass."""
    flags = [c for c in df.columns if c.startswith(FLAG)]
    one = df.agg(*[F.count_if(c).alias(c) for c in flags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c[len(FLAG):]).alias("column_name"), F.col(c).alias("invalid_count")) for c in flags])).alias("x")).select("x.*")


def write_checked(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Writes Parquet to a new path, reads it back and compares the number of rows that were written, from one pass."""
    from pyspark.sql import Observation

    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").option("compression", "snappy")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    back = df.sparkSession.read.parquet(path).count()
    if back != seen.get["n"]:
        raise RuntimeError(f"{path}: wrote {seen.get['n']} rows, read {back}")
    return back


def safe_text(c: str) -> Column:
    """Text that a spreadsheet doesn't take for a formula: a leading = + - or @ gets an apostrophe before it."""
    return F.when(F.col(c).rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header, every text column made safe; raises where reading it back gives other rows or columns.

    mark: a byte order mark before each file's header, by which spreadsheets know UTF-8.
    """
    safe = df.select(*[safe_text(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])
    safe = safe.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else safe
    safe.write.csv(path, header=True, mode="errorifexists")
    back = df.sparkSession.read.csv(path, header=True, multiLine=True)
    if [c.lstrip("\ufeff") for c in back.columns] != df.columns or back.count() != df.count():
        raise RuntimeError(f"{path}: what was read isn't what was written")


def read_inferred(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files with types as Spark infers them: evidence to set against the declared ones, see `schema_differences`."""
    return spark.read.csv(paths, header=True, inferSchema=True)


def read_page(spark: SparkSession, path: str, columns: list[str], rows: int) -> DataFrame:
    """Some columns of a Parquet table, at most `rows` rows: only these columns are read."""
    return spark.read.parquet(path).select(*columns).limit(rows)


def read_partitioned(spark: SparkSession, root: str, **where: object) -> DataFrame:
    """A table in folders name=value: the names become columns, and folders that `where` excludes aren't listed."""
    df = spark.read.option("basePath", root).parquet(root)
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list]:
    """The table's rows in lists of `size`, one partition at a time, so that the driver holds a partition and a list at most."""
    some = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        some.append(row)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as one JSON text, on the file system of the path."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """df, or an error if it has no row: reads one row at most."""
    if df.isEmpty():
        raise ValueError(f"{name}: no rows")
    return df


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns, in its order: missing ones are null, others are left out, types are cast."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def quarantine(df: DataFrame, keys: list[str], valid: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, put aside): rows that aren't valid, and repeated copies of valid rows, go aside with their reason."""
    from pyspark.sql import Window

    ok = F.coalesce(valid, F.lit(False))
    n = F.row_number().over(Window.partitionBy(*keys, ok).orderBy(F.xxhash64(*df.columns)))
    marked = cut(df.withColumns({"_ok": ok, "_n": n}), "marked")
    kept = marked.where("_ok and _n = 1").drop("_ok", "_n")
    aside = marked.where("not (_ok and _n = 1)").withColumn("reason", F.when(~F.col("_ok"), F.lit(reason)).otherwise("repeated")).drop("_ok", "_n")
    return kept, aside


def file_inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes and SHA-256 of files, read and hashed on the executors."""
    f = spark.read.format("binaryFile").load(pattern)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_new(new: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose key the Parquet table at path lacks (all, if there is none); repeated new keys go in once.

    Returns the number of appended rows. Keys are compared as they stand; rows with a null key are left out.
    """
    from pyspark.errors import AnalysisException

    for k in keys:
        new = new.where(F.col(k).isNotNull())
    new = new.dropDuplicates(keys)
    try:
        new = new.join(new.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException:
        pass  # no table yet
    rows = cut(new, "append")
    rows.write.mode("append").parquet(path)
    return rows.count()


def same_table(a: DataFrame, b: DataFrame) -> dict[str, object]:
    """Whether two tables hold the same rows in any order: columns in both, rows of each, equal (by fingerprint of common columns)."""
    from tessera.operators.relational import fingerprint

    common = [c for c in a.columns if c in b.columns]
    x, y = fingerprint(a, common).first(), fingerprint(b, common).first()
    return {"columns": a.columns == b.columns, "rows": (x["rows"], y["rows"]), "equal": x == y and a.columns == b.columns}
