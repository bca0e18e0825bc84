"""Joins, windows and summaries that Spark has no single operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


#: Values at most in the second set of a grid.
GRID = 10_000


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str], bucket: int) -> DataFrame:
    """Each left row with the values of the latest right row of its key whose `since` is at or before its `at`.

    at and since are integers (days, seconds). Left rows without a match, or with a null key or time, keep null values; of right rows
    of one key and time the greatest values win. The time line is cut into buckets: a bucket's rows are matched within it, and what
    earlier buckets end with is carried in from a table of one row per key and bucket. So a key that holds a third of all
    rows is spread over as many tasks as it has buckets. Left columns of the same name as a value are an error.
    """
    slot = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("bigint")
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    r = right.where(there & F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("_t")).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_slot", slot("_t"))
    ends = r.groupBy(*keys, "_slot").agg(F.max_by("_v", "_t").alias("_carry"))
    both = (
        left.withColumns({"_t": F.col(at), "_slot": slot(at), "_side": F.lit(1), "_v": F.lit(None).cast(r.schema["_v"].dataType), "_row": F.struct(*left.columns)})
        .select(*keys, "_t", "_slot", "_side", "_v", "_row")
        .unionByName(r.withColumns({"_side": F.lit(0), "_row": F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType)}))
    )
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_slot").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    matched = both.withColumn("_in", inside).where("_side = 1")
    slots = matched.select(*keys, "_slot").distinct().withColumn("_need", F.lit(True))
    line = slots.join(ends, [*keys, "_slot"], "full_outer")
    carried = F.last("_carry", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("_from", carried).where("_need").select(*keys, "_slot", "_from")
    hit = matched.join(line, [*keys, "_slot"], "left")
    found = F.coalesce("_in", "_from")
    return hit.select("_row.*", *[found[v].alias(v) for v in values])


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """Points joined with the intervals [start, end] of their key that hold them; all three are integers.

    An interval stands once in every bucket that it touches and a point in exactly one, so the join is an equi join on key and
    bucket with a test on top, never a nested loop, and no pair comes out twice. Null bounds hold nothing.
    """
    slots = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("_slot", F.explode(slots))
    out = points.withColumn("_slot", F.floor(F.col(at) / bucket)).alias("p").join(
        spread.alias("i"),
        reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys], (F.col("p._slot") == F.col("i._slot")) & F.col(f"p.{at}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))),
        how,
    )
    return out.select(*[f"p.{c}" for c in points.columns], *([] if how in ("left_semi", "left_anti") else [f"i.{c}" for c in intervals.columns if c not in keys]))


def overlaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended; adds latest_end, the latest end before it."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("latest_end", F.max(end).over(w)).where(F.col(start) <= F.col("latest_end"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark limits each partition before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in this order. Rows with a null key count as one key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def percent_rank(df: DataFrame, value: str, name: str, keys: list[str] | None = None, ties: str | None = None) -> DataFrame:
    """Adds the percent rank of value, nulls first; a null value keeps a null rank but counts in the population."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.asc_nulls_first(value), *([ties] if ties else []))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.percent_rank().over(w)))


def tiles(df: DataFrame, key: str, orders: dict[str, Column], n: int) -> DataFrame:
    """Adds, per name of orders, which of n tiles of the whole table a row is in (1 to n), as ntile over its order and then the key.

    orders: name -> a whole number to sort by, ascending, never null. key must be unique. Rows are sorted over all tasks by range; a
    row's position is its place in its range plus the rows of the ranges before, so no task ever holds the table.
    """
    one = df.select(F.col(key).alias("_key"), F.explode(F.create_map(*[x for name, v in orders.items() for x in (F.lit(name), v.cast("bigint"))])).alias("_name", "_v"))
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(one.repartitionByRange(ranges, "_name", "_v", "_key").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_name", "_range").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_name")  # a row per range
    sizes = sizes.withColumns({"_before": F.sum("_n").over(by.orderBy("_range")) - F.col("_n"), "_all": F.sum("_n").over(by)})
    at = F.row_number().over(Window.partitionBy("_name", "_range").orderBy("_v", "_key")) - 1 + F.col("_before")
    small, more = F.expr(f"_all div {n}"), F.col("_all") % n
    tile = F.when(F.col("_at") < more * (small + 1), F.expr(f"_at div (_all div {n} + 1)")).otherwise(more + F.expr(f"(_at - (_all % {n}) * (_all div {n} + 1)) div greatest(_all div {n}, 1)")) + 1
    found = placed.join(F.broadcast(sizes), ["_name", "_range"]).withColumn("_at", at).groupBy("_key").agg(*[F.max(F.when(F.col("_name") == name, tile)).cast("bigint").alias(name) for name in orders])
    return df.join(found.withColumnRenamed("_key", key), key)


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, bucket: int) -> DataFrame:
    """keys and percentile: the exact interpolated percentile of a whole-number column per group; nulls don't count.

    A histogram of buckets finds in which two the ranks lie, and only these buckets' values are counted one by one. No task holds a
    group's values: it holds a group's buckets, as many as the values' range has.
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("_v"))
    by = Window.partitionBy(*keys)
    rank = (F.lit(p) * (F.col("_all") - 1)).cast("double")

    def holds(rows: DataFrame, at: str) -> DataFrame:
        upto = F.sum("_n").over(by.orderBy(at))
        return rows.withColumns({"_upto": upto + F.col("_before") if "_before" in rows.columns else upto}).where((F.floor(rank) < F.col("_upto")) & (F.ceil(rank) >= F.col("_upto") - F.col("_n")))

    slots = df.groupBy(*keys, F.expr(f"_v div {bucket}").alias("_slot")).agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(by))
    slots = holds(slots, "_slot").withColumn("_before", F.min(F.col("_upto") - F.col("_n")).over(by)).select(*keys, "_slot", "_all", "_before")
    near = df.withColumn("_slot", F.expr(f"_v div {bucket}")).join(slots, [*keys, "_slot"]).groupBy(*keys, "_v", "_all", "_before").agg(F.count("*").alias("_n"))
    share = F.first("_rank") - F.floor(F.first("_rank"))
    return holds(near, "_v").withColumn("_rank", rank).groupBy(*keys).agg((F.min("_v") + share * (F.max("_v") - F.min("_v"))).alias("percentile"))


def unpivot(df: DataFrame, ids: list[str], values: list[str], variable: str = "metric", value: str = "value") -> DataFrame:
    """One row per row and column of values, as doubles."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, variable, value)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null reference no parent has."""
    keys = parent.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every combination of two sets of values, for dense reports, without a nested loop: both are joined on a constant.

    The second set, a dimension of at most `GRID` values, stands in one array; a larger one raises.
    """
    many = b.limit(GRID + 1).agg(F.collect_list(F.struct(*b.columns)).alias("_b")).select(F.when(F.size("_b") > GRID, F.raise_error(F.lit(f"grid: more than {GRID} values")).cast(f"array<struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in b.schema)}>>")).otherwise(F.col("_b")).alias("_b"))
    return a.crossJoin(F.broadcast(many)).select(*a.columns, F.inline("_b"))  # one row


def rules(lines: DataFrame, basket: str, item: str, least: int = 2) -> DataFrame:
    """Association rules in both directions between items of one basket: antecedent, consequent, pair_count, support, confidence, lift.

    Pairs are made within each basket's sorted array, so they need no second shuffle of the lines. Pairs in fewer than `least`
    baskets are left out.
    """
    held = lines.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).groupBy(basket, item).agg(F.lit(1).alias("_one"))
    n = held.agg(F.count_distinct(basket).alias("n_baskets"))
    single = held.groupBy(item).agg(F.count("*").alias("n"))
    arrays = held.groupBy(basket).agg(F.array_sort(F.collect_list(item)).alias("items")).where("size(items) > 1")
    anchored = arrays.select(F.posexplode("items").alias("at", "a"), "items").select("a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("b"))
    pairs = anchored.groupBy("a", "b").agg(F.count("*").alias("pair_count")).where(F.col("pair_count") >= least)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent")), F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent")))).alias("r"), "pair_count").select("r.*", "pair_count")
    return (
        both.join(single.select(F.col(item).alias("antecedent"), F.col("n").alias("n_a")), "antecedent")
        .join(single.select(F.col(item).alias("consequent"), F.col("n").alias("n_c")), "consequent")
        .crossJoin(F.broadcast(n))
        .select(
            "antecedent", "consequent", "pair_count", (F.col("pair_count") / F.col("n_baskets")).alias("support"), (F.col("pair_count") / F.col("n_a")).alias("confidence"),
            (F.col("pair_count") * F.col("n_baskets") / (F.col("n_a") * F.col("n_c"))).alias("lift"),
        )
    )


def error_metrics(scored: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """n, mae, rmse, mape (over non-zero actuals, in per cent) and r2 per group; predictions are floored at 0."""
    p, a = F.greatest(F.col(predicted), F.lit(0.0)), F.col(actual).cast("double")
    return (
        scored.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"), F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg(F.pow(a - p, 2))).alias("rmse"), F.avg(F.when(a != 0, F.abs((a - p) / a) * 100)).alias("mape"),
            F.when(F.var_pop(a) > 0, 1 - F.sum(F.pow(a - p, 2)) / (F.var_pop(a) * F.count("*"))).alias("r2"),
        )
    )


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, blanks (null or empty), distinct values, least and greatest value as text. One pass over the table."""
    aggs = []
    for c in columns:
        text = F.col(c).cast("string")
        aggs += [F.count(F.when(text.isNull() | (F.trim(text) == ""), 1)).alias(f"{c}\x1fblank"), F.count_distinct(c).alias(f"{c}\x1fdistinct"), F.min(c).cast("string").alias(f"{c}\x1fleast"), F.max(c).cast("string").alias(f"{c}\x1fgreatest")]
    one = df.agg(F.count("*").alias("_rows"), *aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), *[F.col(f"`{c}\x1f{x}`").alias(x) for x in ("blank", "distinct", "least", "greatest")]) for c in columns])
    return one.select(F.explode(parts).alias("p")).select("p.*")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """An order-independent fingerprint: rows, the sum of row hashes and, per column, of value hashes, all modulo 2^63 - 25.

    Equal tables give equal fingerprints however they are partitioned or sorted; repeated rows count as often as they occur.
    """
    m = F.lit(2**63 - 25).cast("decimal(20,0)")
    h = lambda *cs: F.sum(F.xxhash64(*cs).cast("decimal(38,0)"))
    fold = lambda c: F.pmod(F.col(c), m).cast("decimal(20,0)").cast("string").alias(c)
    one = df.agg(F.count("*").alias("rows"), h(*columns).alias("table_hash"), *[h(c).alias(f"{c}_hash") for c in columns])
    return one.select("rows", fold("table_hash"), *[fold(f"{c}_hash") for c in columns])


def cohorts(events: DataFrame, entity: str, day: str) -> DataFrame:
    """Retention: cohort (first month, yyyy-MM), offset in months, active entities, and their share of the cohort in per cent."""
    months = events.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(entity, (F.year(day) * 12 + F.month(day) - 1).alias("m")).distinct()
    own = months.withColumn("c", F.min("m").over(Window.partitionBy(entity)))
    per = own.groupBy("c", (F.col("m") - F.col("c")).alias("offset")).agg(F.count("*").alias("active"))
    size = F.max(F.when(F.col("offset") == 0, F.col("active"))).over(Window.partitionBy("c"))
    label = F.concat_ws("-", F.floor(F.col("c") / 12).cast("string"), F.lpad((F.col("c") % 12 + 1).cast("string"), 2, "0"))
    return per.select(label.alias("cohort"), "offset", "active", (F.col("active") * 100.0 / size).alias("retention_pct"))
