"""Totals over trailing periods, by binary doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def spine(daily: DataFrame, keys: list[str], day: str, last: DataFrame | None = None) -> DataFrame:
    """Every day of each entity from its first day to the last day of any entity (or that of the one-row frame `last`).

    daily: one row per keys and day. Gives keys and day; days between without a row appear too. Empty input gives no rows.
    """
    end = last if last is not None else daily.agg(F.max(day).alias("_last"))
    return (
        daily.groupBy(*keys)
        .agg(F.min(day).alias("_first"))
        .crossJoin(F.broadcast(end.select(F.col(end.columns[0]).alias("_last"))))  # one row
        .select(*keys, F.explode(F.sequence("_first", "_last", F.expr("interval 1 day"))).alias(day))
    )


def dense(daily: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """daily with a row for every day of the spine; values are 0 on days that had none."""
    full = spine(daily, keys, day).join(daily.select(*keys, day, *values), [*keys, day], "left")
    return full.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})


def blocks(window: int) -> list[int]:
    """The powers of two that add up to window, largest first: 30 -> [16, 8, 4, 2]."""
    return [1 << b for b in range(window.bit_length() - 1, -1, -1) if window >> b & 1]


def trailing_sums(series: DataFrame, keys: list[str], day: str, value: str, windows: tuple[int, ...]) -> DataFrame:
    """Adds sum_w for each window w: the total of value over the w days ending on the day, that day included.

    series must be gap-free per entity (see `dense`); days before an entity's first count as 0. Sums of 1, 2, 4, 8, ... days come
    from each other by one shift each, and a window is put together from shifted blocks, so that d doublings serve every
    window below 2^(d+1). All shifts share one partitioning and order: one exchange and one sort, whatever the windows.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    back = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(0)) if n else F.col(c)
    out = series.withColumn("_s1", F.col(value).cast("bigint") if dict(series.dtypes)[value] in ("int", "smallint", "tinyint", "bigint") else F.col(value))
    size = 1
    while size * 2 <= max(windows):
        out = out.withColumn(f"_s{size * 2}", F.col(f"_s{size}") + back(f"_s{size}", size))
        size *= 2
    sums: dict[str, Column] = {}
    for n in windows:
        at, total = 0, None
        for b in blocks(n):
            piece = back(f"_s{b}", at)
            total = piece if total is None else total + piece
            at += b
        sums[f"sum_{n}"] = total
    out = out.withColumns(sums)
    return out.drop(*[c for c in out.columns if c.startswith("_s")])


def trailing_totals(events: DataFrame, key: str, day: str, value: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per entity and day, days without activity included: the day's total, sum_w and avg_w of each trailing window w.

    events: any number of rows per entity and day; rows with a null key, day or value don't count. The rows of an entity are
    added up by day on the map side first, so an entity that holds a third of all rows moves a row per day and map task. An
    entity's days run from its first to the last day of any entity; avg_w divides by w always. Also gives day_no, from 0.
    """
    daily = events.where(F.col(key).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(key, day).agg(F.sum(value).alias("total"))
    daily = cut(daily, "daily")  # a row per entity and day, read for the spine, its end and the values
    out = trailing_sums(dense(daily, [key], day, ["total"]), [key], day, "total", windows)
    first = F.min(day).over(Window.partitionBy(key))
    return out.withColumns({f"avg_{n}": F.col(f"sum_{n}") / F.lit(n) for n in windows} | {"day_no": F.datediff(day, first)})
