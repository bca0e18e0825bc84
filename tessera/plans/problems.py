"""Queries of the data-repair problems: missing values, broken references, units, trailing totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.calendar import real_day
from tessera.functions.keys import earliest, key_or_null, norm
from tessera.operators import stock, trailing, units
from tessera.operators.references import Reference, orphans
from tessera.sources.catalog import table

REFERENCES = [
    Reference("restaurant_orders", "order_id", "customer_id", "customers", "customer_id"),
    Reference("order_items", "order_item_id", "item_id", "menu_items", "item_id"),
    Reference("inventory", "inventory_id", "restaurant_id", "restaurants", "restaurant_id"),
    Reference("menu_items", "item_id", "category_id", "menu_categories", "category_id"),
]


def p1_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Stock sheets with every gap filled and marked."""
    return stock.filled_sheets(table(spark, folder, "inventory"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cells that the fill operator filled."""
    return stock.filled_cells(table(spark, folder, "inventory")).select("inventory_id", "field_name").distinct()


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    names = {r.child for r in REFERENCES} | {r.parent for r in REFERENCES}
    return orphans({n: table(spark, folder, n) for n in names}, table(spark, folder, "deleted_records"), REFERENCES)


def p3_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Broken references per table, month of loaded_at and reason."""
    return _orphans(spark, folder).groupBy("table_name", "column_name", F.date_format("month", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphans"), F.count_distinct("ref_key").alias("missing_keys"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose reference names no parent that existed when they were loaded."""
    return _orphans(spark, folder).select("table_name", "row_key").distinct()


def p4_converted(spark: SparkSession, folder: str) -> DataFrame:
    """Consumed and closing stocks in kg, liters or pcs, with the unit found for each and how sure it is."""
    return units.unit_cells(_sheets(spark, folder))


def _sheets(spark: SparkSession, folder: str) -> DataFrame:
    need = ["inventory_id", "restaurant_id", "item_id", *units.FIELDS, "unit"]
    return earliest(table(spark, folder, "inventory").select(*need, "loaded_at"), "inventory_id", need)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells whose number isn't in the common unit of the item."""
    return units.unit_cells(_sheets(spark, folder)).where("must_change").select("inventory_id", "field_name").distinct()


def item_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row per counted order line: item_id, day, quantity.

    A line delivered more than once counts once. Its day is its order's: order_date if a real calendar day, else the day of
    order_datetime; lines without one, without an item key, or with a quantity that is null or below 1 don't count.
    """
    items = table(spark, folder, "order_items").select(norm("order_item_id").alias("line"), norm("order_id").alias("order_id"), key_or_null("item_id").alias("item_id"), "quantity", "loaded_at")
    lines = earliest(items, "line", ["order_id", "item_id", "quantity"]).where("item_id is not null and quantity >= 1")
    # an order's lines of one item are one row before the join, so that one order can't be hot
    lines = lines.groupBy("order_id", "item_id").agg(F.sum("quantity").alias("quantity"))
    raw = table(spark, folder, "restaurant_orders").select(norm("order_id").alias("order_id"), F.coalesce(real_day("order_date"), F.col("order_datetime").cast("date")).alias("day"), "loaded_at")
    days = earliest(raw, "order_id", ["day"]).where("day is not null")
    return lines.join(days.select("order_id", "day"), "order_id").select("item_id", "day", "quantity")


def p5_trailing(spark: SparkSession, folder: str) -> DataFrame:
    """Per item and day, days without a sale included: quantity, totals and averages over 7 and 30 days."""
    out = trailing.trailing_totals(item_days(spark, folder), "item_id", "day", "quantity")
    return out.select("item_id", F.date_format("day", "yyyy-MM-dd").alias("day_text"), "total", F.col("sum_7"), F.col("sum_30"), F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30"), F.col("day_no").cast("bigint").alias("day_no"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items and days on which the last week runs at twice the month's pace."""
    out = trailing.trailing_totals(item_days(spark, folder), "item_id", "day", "quantity")
    return out.where("day_no >= 29 and sum_7 >= 20 and sum_7 * 30 >= 14 * sum_30").select("item_id", F.date_format("day", "yyyy-MM-dd").alias("day_text"))


QUERIES = {f.__name__: f for f in (p1_filled, p1_found, p3_by_month, p3_found, p4_converted, p4_found, p5_trailing, p5_found)}

_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c: str) -> str:
    return f"upper(regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g'))"


def _key(c: str) -> str:
    return f"case when regexp_matches({c}, '[0-9]') then {_norm(c)} end"


_P3 = f"""
with rows_ as (
  {" union all ".join(f"select '{r.child}' table_name, '{r.column}' column_name, '{r.parent}' parent, {_norm(r.child_key)} row_key, {_key(r.column)} ref_key, loaded_at from {r.child}" for r in REFERENCES)}
), child as (
  select table_name, column_name, parent, row_key, min(ref_key) ref_key, min(loaded_at) loaded_at from rows_ group by all
), parents as (
  select parent, key, min(born) born from (
    {" union all ".join(f"select '{r.parent}' parent, {_norm(r.parent_key)} as key, loaded_at born from {r.parent}" for r in REFERENCES)}
  ) group by all
), gone as (select lower(trim(table_name)) parent, {_norm("record_key")} as key, min(deleted_at) died from deleted_records group by all),
orphans as (
  select c.*, case when p.key is null then 'never_existed' when g.died <= c.loaded_at then 'deleted' when p.born > c.loaded_at then 'not_yet_loaded' end reason
  from child c left join parents p on p.parent = c.parent and p.key = c.ref_key left join gone g on g.parent = c.parent and g.key = c.ref_key
  where c.ref_key is not null
)
"""

_DAY = """coalesce(
  try_strptime(regexp_extract(trim(order_date), '^(\\d{4}-\\d{1,2}-\\d{1,2})([ T]\\d{1,2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?$', 1), '%Y-%m-%d')::date,
  try_strptime(regexp_extract(trim(order_date), '^\\d{4}/\\d{1,2}/\\d{1,2}$'), '%Y/%m/%d')::date,
  try_strptime(regexp_extract(trim(order_date), '^(\\d{1,2}/\\d{1,2}/\\d{4})( \\d{1,2}:\\d{2}(:\\d{2})?)?$', 1), '%m/%d/%Y')::date,
  try_strptime(regexp_extract(trim(order_date), '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$'), '%d.%m.%Y')::date,
  order_datetime::date)"""

_P5 = f"""
with lines as (
  select {_norm("order_item_id")} line, min({_norm("order_id")}) order_id, min({_key("item_id")}) item_id, min(quantity) quantity from order_items where order_item_id is not null group by 1
), days as (select {_norm("order_id")} order_id, min({_DAY}) as day from restaurant_orders group by 1),
daily as (
  select item_id, day, sum(quantity) total from lines join days using (order_id) where item_id is not null and quantity >= 1 and day is not null group by all
), spine as (
  select item_id, unnest(generate_series(f, (select max(day) from daily), interval 1 day))::date as day, f from (select item_id, min(day) f from daily group by 1)
), full_ as (
  select s.item_id, s.day, datediff('day', s.f, s.day) day_no, coalesce(d.total, 0) total from spine s left join daily d using (item_id, day)
), out_ as (
  select *, sum(total) over w7 s7, sum(total) over w30 s30 from full_
  window w7 as (partition by item_id order by day rows between 6 preceding and current row), w30 as (partition by item_id order by day rows between 29 preceding and current row)
)
"""

SQL = {
    "p1_found": f"""
with sheets as (select {_norm("inventory_id")} k, any_value(inventory_id) inventory_id, any_value(restaurant_id) r, any_value(item_id) i, any_value(consumed_stock) c from inventory group by 1)
select inventory_id, 'restaurant_id' as field_name from sheets where r is null or not regexp_matches(r, '[0-9]')
union select inventory_id, 'item_id' from sheets where i is null or not regexp_matches(i, '[0-9]')
union select inventory_id, 'consumed_stock' from sheets
where c is null or not regexp_matches(trim(c), '^[+]?[0-9]') or try_cast(replace(trim(c), ',', '.') as double) >= 1e6""",
    "p3_found": _P3 + "select distinct table_name, row_key from orphans where reason is not null",
    "p3_by_month": _P3
    + "select table_name, column_name, strftime(loaded_at, '%Y-%m') as month, reason, count(*)::bigint orphans, count(distinct ref_key)::bigint missing_keys from orphans where reason is not null group by all",
    "p5_found": _P5 + "select item_id, strftime(day, '%Y-%m-%d') day_text from out_ where day_no >= 29 and s7 >= 20 and s7 * 30 >= 14 * s30",
    "p5_trailing": _P5
    + "select item_id, strftime(day, '%Y-%m-%d') day_text, total::bigint total, s7::bigint sum_7, s30::bigint sum_30, round(s7 / 7.0, 6)::double avg_7, round(s30 / 30.0, 6)::double avg_30, day_no::bigint day_no from out_",
}
