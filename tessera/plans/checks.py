"""Detectors of faulty records, gates on tables, unions, registers and listings of the restaurant tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.arith import r, ratio
from tessera.functions.calendar import real_day, season, time_of_day
from tessera.functions.keys import key_or_null, norm, strip
from tessera.operators import cleaning as C
from tessera.operators import relational as R
from tessera.plans import problems
from tessera.plans.book import Book
from tessera.sources.catalog import CATALOG, table

book = Book()
_key, _norm, _DAY = problems._key, problems._norm, problems._DAY

#: Tables whose blanks are counted, with the columns that a complete record fills.
FILLED = {
    "restaurant_orders": ("order_id", "customer_id", "restaurant_id", "order_datetime", "order_date", "channel", "payment_method", "status"),
    "order_items": ("order_item_id", "order_id", "item_id", "quantity", "unit_price", "discount_percent", "line_subtotal", "line_total"),
    "customers": ("customer_id", "first_name", "last_name", "gender", "age", "city", "email", "phone"),
    "inventory": ("inventory_id", "restaurant_id", "item_id", "month_start", "consumed_stock", "unit"),
    "menu_items": ("item_id", "item_name", "category_id", "base_cost", "base_price"),
}
UNITS = ("kg", "liters", "pcs")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (strip(c) == "")


#: A text that is a plain number, for arithmetic on raw stock cells.
_PLAIN = r"^[-+]?[0-9]+(\.[0-9]+)?$"


def _plain(c: str) -> Column:
    return F.when(strip(c).rlike(_PLAIN), strip(c)).cast("double")


def _plain_sql(c: str) -> str:
    return f"case when regexp_matches(trim({c}), '{_PLAIN}') then trim({c})::double end"


def _conditions(t: str) -> dict[str, Column]:
    """Detector -> condition of a faulty row of table t; null is no fault."""
    out = {"missing_values": reduce(lambda a, b: a | b, [_blank(c) for c in FILLED[t]])}
    if t == "restaurant_orders":
        dated = strip("order_date") != ""
        out |= {"invalid_dates": dated & real_day("order_date").isNull(), "missing_customer_ids": key_or_null("customer_id").isNull(), "cancelled_transactions": F.lower(strip("status")) == "cancelled"}
    elif t == "order_items":
        off = F.abs(F.col("line_total").cast("double") - F.col("line_subtotal").cast("double") * (1 - F.col("discount_percent").cast("double") / 100))
        out |= {
            "invalid_menu_prices": F.col("unit_price").isNull() | (F.col("unit_price") <= 0), "negative_quantities": F.col("quantity") <= 0, "missing_menu_ids": key_or_null("item_id").isNull(),
            "incorrect_discounts": ~F.col("discount_percent").between(0, 100) | (off > 0.02),
        }
    elif t == "menu_items":
        out |= {"invalid_menu_prices": F.col("base_price").isNull() | (F.col("base_price") <= 0)}
    elif t == "inventory":
        used, had = _plain("consumed_stock"), _plain("opening_stock") + _plain("received_stock")
        out |= {"impossible_wastage_quantities": (used < 0) | (used > had), "inconsistent_units": ~F.coalesce(F.lower(strip("unit")).isin(*UNITS), F.lit(False))}
    return out


#: The same in SQL.
_CONDITIONS = {
    **{(t, "missing_values"): " or ".join(f"{c} is null or trim({c}::varchar) = ''" for c in columns) for t, columns in FILLED.items()},
    ("restaurant_orders", "invalid_dates"): f"trim(order_date) <> '' and {_DAY.replace('order_datetime::date', 'null')} is null",
    ("restaurant_orders", "missing_customer_ids"): f"{_key('customer_id')} is null",
    ("restaurant_orders", "cancelled_transactions"): "lower(trim(status)) = 'cancelled'",
    ("order_items", "invalid_menu_prices"): "unit_price is null or unit_price <= 0",
    ("order_items", "negative_quantities"): "quantity <= 0",
    ("order_items", "missing_menu_ids"): f"{_key('item_id')} is null",
    ("order_items", "incorrect_discounts"): "discount_percent not between 0 and 100 or abs(line_total::double - line_subtotal::double * (1 - discount_percent::double / 100)) > 0.02",
    ("menu_items", "invalid_menu_prices"): "base_price is null or base_price <= 0",
    ("inventory", "impossible_wastage_quantities"): f"{_plain_sql('consumed_stock')} < 0 or {_plain_sql('consumed_stock')} > {_plain_sql('opening_stock')} + {_plain_sql('received_stock')}",
    ("inventory", "inconsistent_units"): f"not coalesce(lower(trim(unit)) in {UNITS}, false)",
}

#: A rating is a twentieth of an event's value and one; anything but 1 to 5 is none.
_BAD_RATING = "not coalesce(floor(value / 20) + 1 between 1 and 5, false)"
_GROUPS = {"duplicate_orders": ("restaurant_orders", "order_id"), "duplicate_order_lines": ("order_items", "order_item_id")}
_PARENTS = {
    "missing_menu_ids": (("order_items", "item_id", "menu_items", "item_id"),),
    "invalid_restaurant_ids": (("restaurant_orders", "restaurant_id", "restaurants", "restaurant_id"),),
    "invalid_location_references": (("inventory", "restaurant_id", "restaurants", "restaurant_id"), ("customers", "home_restaurant_id", "restaurants", "restaurant_id")),
}


def _detector_sql() -> str:
    parts = [f"select '{d}' detector, count(*) filter ({sql}) n from {t}" for (t, d), sql in _CONDITIONS.items()]
    parts.append(f"select 'invalid_ratings', count(*) filter ({_BAD_RATING}) from events")
    parts += [f"select '{d}', count(*) from (select {_norm(k)} from {t} where {k} is not null group by 1 having count(*) > 1)" for d, (t, k) in _GROUPS.items()]
    parts += [
        f"select '{d}', count(*) from {child} where {_key(c)} is not null and {_key(c)} not in (select {_key(k)} from {parent} where {_key(k)} is not null)"
        for d, refs in _PARENTS.items() for child, c, parent, k in refs
    ]
    return "select detector, sum(n)::bigint found from (" + " union all ".join(parts) + ") group by 1"


@book.add(_detector_sql())
def quality_detectors(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen detectors with their findings: one pass of counters per table, groups of repeated keys, and references without a parent.

    Blank menu ids count as missing, and references to items that aren't there too; a key that repeats counts once per key.
    """
    rows = []
    for t in FILLED:
        ds = _conditions(t)
        one = table(spark, folder, t).agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(d) for d, bad in ds.items()])
        rows.append(one.select(F.inline(F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).alias("n")) for d in ds]))))
    rows.append(table(spark, folder, "events").agg(F.count_if(F.expr(_BAD_RATING)).alias("n")).select(F.lit("invalid_ratings").alias("detector"), "n"))
    for d, (t, k) in _GROUPS.items():
        rows.append(table(spark, folder, t).where(F.col(k).isNotNull()).groupBy(norm(k).alias("k")).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(d).alias("detector"), "n"))
    for d, refs in _PARENTS.items():
        for child, c, parent, k in refs:
            have = table(spark, folder, parent).select(key_or_null(k).alias("k")).where("k is not null").distinct()
            rows.append(table(spark, folder, child).select(key_or_null(c).alias("k")).where("k is not null").join(have, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(d).alias("detector"), "n"))
    return reduce(DataFrame.unionByName, rows).groupBy("detector").agg(F.sum("n").alias("found"))


_LINE_FLAGS = "case when quantity is null or quantity <= 0 then 'quantity' end, case when unit_price is null or unit_price <= 0 or unit_price > 10000 then 'price' end, case when discount_percent is null or discount_percent not between 0 and 100 then 'discount' end"


@book.add(f"select concat_ws('+', {_LINE_FLAGS}) flags, count(*) n_lines from order_items group by 1")
def line_flags(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each order line, as one text of flags, counted."""
    low = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    q, p, d = F.col("quantity") > 0, (F.col("unit_price") > 0) & (F.col("unit_price") <= 10000), F.col("discount_percent").between(0, 100)
    return table(spark, folder, "order_items").groupBy(F.concat_ws("+", low(q, "quantity"), low(p, "price"), low(d, "discount")).alias("flags")).agg(F.count("*").alias("n_lines"))


def _joins() -> list[tuple[str, str, str, str]]:
    return [(c, col, p, k) for c in ("restaurant_orders", "order_items", "inventory", "menu_items", "customers") for col, (p, k) in CATALOG[c].parents.items()]


@book.add(
    " union all ".join(
        f"select '{c}.{col}' relationship, count(*) n_rows, count(r.{k}) n_matched, count(distinct r.{k})::bigint n_parents from {c} l left join {p} r on l.{col}::varchar = r.{k}::varchar" for c, col, p, k in _joins()
    )
)
def integration_joins(spark: SparkSession, folder: str) -> DataFrame:
    """The required joins, each on its own, right columns prefixed, keys as text: a right key that was delivered again multiplies rows."""
    rows = []
    for c, col, p, k in _joins():
        j = C.prefixed_join(table(spark, folder, c), col, table(spark, folder, p), k, p)
        one = j.agg(F.count("*").alias("n_rows"), F.count(f"{p}__{k}").alias("n_matched"), F.count_distinct(f"{p}__{k}").alias("n_parents"))
        rows.append(one.select(F.lit(f"{c}.{col}").alias("relationship"), "n_rows", "n_matched", "n_parents"))
    return reduce(DataFrame.unionByName, rows)


@book.add(
    f"""select coalesce(upper(trim(channel)), 'UNKNOWN') channel, promo is not null promoted, count(*) n_orders from (
      select {_norm("order_id")} k, min(channel) channel, min(nullif(trim(promotion_id), '')) promo from restaurant_orders where order_id is not null group by 1) group by all"""
)
def cleaned_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, once each, by channel (unknown where none is given) and by whether they name a promotion (blank is none)."""
    o = table(spark, folder, "restaurant_orders").where("order_id is not null").groupBy(norm("order_id").alias("k")).agg(F.min("channel").alias("channel"), F.min(F.nullif(F.trim("promotion_id"), F.lit(""))).alias("promo"))
    return o.groupBy(F.coalesce(F.upper(F.trim("channel")), F.lit("UNKNOWN")).alias("channel"), F.col("promo").isNotNull().alias("promoted")).agg(F.count("*").alias("n_orders"))


@book.add(f"select row_number() over (order by first_seen, channel)::bigint channel_no, channel, first_seen, n_rows from (select {_norm('channel')} channel, min(loaded_at) first_seen, count(*) n_rows from restaurant_orders where trim(channel) <> '' group by 1)")
def channel_register(spark: SparkSession, folder: str) -> DataFrame:
    """Channels as they were first observed, numbered: a dimension that registers itself."""
    c = table(spark, folder, "restaurant_orders").where(strip("channel") != "").groupBy(norm("channel").alias("channel")).agg(F.min("loaded_at").alias("first_seen"), F.count("*").alias("n_rows"))
    return c.withColumn("channel_no", F.row_number().over(Window.orderBy("first_seen", "channel")).cast("bigint"))  # a row per channel


@book.add(f"select {_key('item_id')} item_id, max(is_active::int)::bigint available, count(*) deliveries from menu_items where {_key('item_id')} is not null group by 1")
def item_availability(spark: SparkSession, folder: str) -> DataFrame:
    """Whether any delivery of an item says that it is available: a max over flags."""
    return table(spark, folder, "menu_items").select(key_or_null("item_id").alias("item_id"), "is_active").where("item_id is not null").groupBy("item_id").agg(F.max(F.col("is_active").cast("int")).cast("bigint").alias("available"), F.count("*").alias("deliveries"))


def listing(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in an order, at most `limit`, which is brought between 1 and 5,000: a page of records."""
    return df.orderBy(*order).limit(max(1, min(5000, limit)))


@book.add("select restaurant_id, restaurant_name, city, loaded_at from restaurants order by restaurant_id, loaded_at limit 5000")
def restaurant_listing(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the restaurants."""
    return listing(table(spark, folder, "restaurants").select("restaurant_id", "restaurant_name", "city", "loaded_at"), ["restaurant_id", "loaded_at"], 100_000)


@book.add(
    f"""select name, n_lines, quantity from (select coalesce(m.name, 'Unknown') as name, count(*) n_lines, sum(quantity)::bigint quantity from order_items o
      left join (select {_key('item_id')} k, min(item_name) as name from menu_items where {_key('item_id')} is not null group by 1) m on m.k = {_key('item_id').replace('item_id', 'o.item_id')} group by 1) order by n_lines desc, name limit 20"""
)
def top_named_items(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty items with most lines by name, "Unknown" for lines that name none: a top-k report."""
    m = table(spark, folder, "menu_items").select(key_or_null("item_id").alias("k"), "item_name").where("k is not null").groupBy("k").agg(F.min("item_name").alias("name"))
    per = table(spark, folder, "order_items").groupBy(key_or_null("item_id").alias("k")).agg(F.count("*").alias("n"), F.sum("quantity").alias("q"))
    out = per.join(m, "k", "left").groupBy(F.coalesce("name", F.lit("Unknown")).alias("name")).agg(F.sum("n").alias("n_lines"), F.sum("q").cast("bigint").alias("quantity"))
    return out.orderBy(F.desc("n_lines"), "name").limit(20)


@book.add(
    f"""select 'restaurant' kind, {_key("restaurant_id")} as key, restaurant_name as name, city, null::double price from restaurants union all select 'item', {_key("item_id")}, item_name, null, base_price::double from menu_items
    union all select 'category', {_key("category_id")}, category_name, null, null from menu_categories"""
)
def entity_register(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the dimensions in one table; columns that a kind lacks are null."""
    a = table(spark, folder, "restaurants").select(F.lit("restaurant").alias("kind"), key_or_null("restaurant_id").alias("key"), F.col("restaurant_name").alias("name"), "city")
    b = table(spark, folder, "menu_items").select(F.lit("item").alias("kind"), key_or_null("item_id").alias("key"), F.col("item_name").alias("name"), F.col("base_price").cast("double").alias("price"))
    c = table(spark, folder, "menu_categories").select(F.lit("category").alias("kind"), key_or_null("category_id").alias("key"), F.col("category_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


_SPLIT = f"(select {_norm('order_id')} k, min({_DAY}) as day from restaurant_orders where order_id is not null group by 1)"


@book.add(
    f"""select split, count(*) n_orders, min(day) first_day, max(day) last_day from (select day, case when day < date '2025-09-01' then 'train' when day < date '2025-11-01' then 'validation' else 'test' end split from {_SPLIT} where day is not null) group by 1"""
)
def split_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Three splits by date in one table with their label, and their bounds: chronological, without a day in two."""
    o = table(spark, folder, "restaurant_orders").where("order_id is not null").groupBy(norm("order_id").alias("k")).agg(F.min(F.coalesce(real_day("order_date"), F.col("order_datetime").cast("date"))).alias("day")).where("day is not null")
    label = F.when(F.col("day") < "2025-09-01", "train").when(F.col("day") < "2025-11-01", "validation").otherwise("test")
    return o.groupBy(label.alias("split")).agg(F.count("*").alias("n_orders"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@book.add(
    f"""select case when month(seen) in (12, 1, 2) then 'Winter' when month(seen) <= 5 then 'Spring' when month(seen) <= 8 then 'Summer' else 'Autumn' end season,
      case when hour(seen) between 5 and 11 then 'Morning' when hour(seen) between 12 and 16 then 'Afternoon' when hour(seen) between 17 and 21 then 'Evening' else 'Night' end time_of_day, count(*) n_orders, round(sum(total) / 100.0, 2) revenue
    from (select {_norm('order_id')} k, min(order_datetime) seen, min((total_amount * 100)::bigint) total from restaurant_orders where order_id is not null group by 1) where seen is not null group by all"""
)
def season_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and revenue by season and time of day."""
    o = table(spark, folder, "restaurant_orders").where("order_id is not null").groupBy(norm("order_id").alias("k")).agg(F.min("order_datetime").alias("at"), F.min((F.col("total_amount") * 100).cast("bigint")).alias("total")).where("at is not null")
    return o.groupBy(season("at").alias("season"), time_of_day("at").alias("time_of_day")).agg(F.count("*").alias("n_orders"), r(F.sum("total") / 100.0, 2).alias("revenue"))


_HASHED = ("order_item_id", "order_id", "item_id", "quantity", "unit_price", "discount_percent", "line_subtotal", "line_total")


@book.add("select count(*) n_rows, count(distinct h)::bigint n_distinct, sum(('0x' || substr(h, 1, 8))::bigint)::bigint fingerprint from (select sha256(concat_ws('|', " + ", ".join(f"coalesce({c}::varchar, '')" for c in _HASHED) + ")) h from order_items)")
def row_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """An order-independent fingerprint that any engine can repeat: the sum of the heads of SHA-256 row hashes, and the distinct rows."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _HASHED]), 256)
    return table(spark, folder, "order_items").groupBy(h.alias("h")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("n")).alias("fingerprint"))


_NUMBERS = ("quantity", "unit_price", "discount_percent", "line_subtotal", "line_total")


@book.add(" union all ".join(f"select '{c}' column_name, count(*) n_rows, count({c}) n_filled, count(distinct {c})::bigint n_distinct, min({c})::double least, max({c})::double greatest, round(quantile_cont({c}::double, 0.5), 6) median, mode({c}::double order by {c}) commonest from order_items".replace(f"mode({c}::double order by {c})", f"(select {c}::double from order_items where {c} is not null group by {c} order by count(*) desc, {c} limit 1)") for c in _NUMBERS))
def number_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per number column: rows, filled, distinct, bounds, exact median and commonest value, from one histogram of (column, value)."""
    long = table(spark, folder, "order_items").select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("decimal(20,2)").alias("v")) for c in _NUMBERS])))
    per = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    out = per.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_filled"), F.count("v").alias("n_distinct"), F.min("v").cast("double").alias("least"), F.max("v").cast("double").alias("greatest"),
        F.max(F.when(F.col("v").isNotNull(), F.struct(F.col("n"), -F.col("v"))))["col2"].alias("_c"),
    )
    median = R.exact_percentile(long.withColumn("c", (F.col("v") * 100).cast("bigint")), ["column_name"], "c", 0.5, bucket=10_000)
    return out.join(median, "column_name", "left").select("column_name", "n_rows", "n_filled", "n_distinct", "least", "greatest", r(F.col("percentile") / 100.0).alias("median"), (-F.col("_c")).cast("double").alias("commonest"))


_RATED = "(select event_type item, user_id % 10 place, user_id, ts::date as day, (floor(value / 20) + 1)::bigint rating from events)"
_RATED_BY = "count(*) rating_count, round(avg(rating), 6) average_rating, round(stddev_pop(rating), 6) spread, count(distinct user_id)::bigint raters, strftime(min(day), '%Y-%m') first_month"


def _rated(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Ratings in range only, by keys, in one pass with a two-level distinct count."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("item"), (F.col("user_id") % 10).alias("place"), "user_id", F.to_date("ts").alias("day"), (F.floor(F.col("value") / 20) + 1).alias("rating")).where(F.col("rating").between(1, 5))
    return e.groupBy(*keys).agg(F.count("*").alias("rating_count"), r(F.avg("rating")).alias("average_rating"), r(F.stddev_pop("rating")).alias("spread"), F.count_distinct("user_id").alias("raters"), F.date_format(F.min("day"), "yyyy-MM").alias("first_month"))


@book.add(f"select place, {_RATED_BY} from {_RATED} where rating between 1 and 5 group by all")
def rating_by_place(spark: SparkSession, folder: str) -> DataFrame:
    return _rated(spark, folder, "place")


@book.add(f"select item, place, {_RATED_BY} from {_RATED} where rating between 1 and 5 group by all")
def rating_by_item_place(spark: SparkSession, folder: str) -> DataFrame:
    return _rated(spark, folder, "item", "place")


@book.add(
    f"""select table_name, n_rows, least_rows, n_rows >= least_rows enough from (select 'restaurants' table_name, count(*) n_rows, 20 least_rows from restaurants union all select 'menu_items', count(*), 100 from menu_items
    union all select 'customers', count(*), 1000 from customers union all select 'restaurant_orders', count(*), 5000 from restaurant_orders)"""
)
def row_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Tables against the rows they must have at least."""
    least = {"restaurants": 20, "menu_items": 100, "customers": 1000, "restaurant_orders": 5000}
    rows = [table(spark, folder, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows", F.lit(n).alias("least_rows"), (F.col("n_rows") >= n).alias("enough")) for t, n in least.items()]
    return reduce(DataFrame.unionByName, rows)


@book.add(
    f"""select {_norm('restaurant_id')} restaurant_id, count(*) n_orders, round(count(*) filter (lower(trim(status)) = 'cancelled') * 100.0 / count(*), 6) cancelled_pct, round(count(*) filter (trim(promotion_id) <> '') * 100.0 / count(*), 6) promoted_pct,
      round(sum((total_amount * 100)::bigint) / 100.0 / count(*), 6) mean_order, count(distinct {_norm('customer_id')})::bigint customers from restaurant_orders where {_key('restaurant_id')} is not null group by 1"""
)
def branch_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as delivered, per branch: shares of cancelled and promoted ones, mean value, customers."""
    o = table(spark, folder, "restaurant_orders").where(key_or_null("restaurant_id").isNotNull())
    per = o.groupBy(norm("restaurant_id").alias("restaurant_id"), norm("customer_id").alias("c")).agg(
        F.count("*").alias("n"), F.count_if(F.lower(F.trim("status")) == "cancelled").alias("x"), F.count_if(F.trim("promotion_id") != "").alias("p"), F.sum((F.col("total_amount") * 100).cast("bigint")).alias("t")
    )
    out = per.groupBy("restaurant_id").agg(*[F.sum(c).alias(c) for c in "nxpt"], F.count("c").alias("customers"))
    return out.select("restaurant_id", F.col("n").alias("n_orders"), r(ratio("x", "n", 100)).alias("cancelled_pct"), r(ratio("p", "n", 100)).alias("promoted_pct"), r(F.col("t") / 100.0 / F.col("n")).alias("mean_order"), "customers")


QUERIES, SQL = book.queries, book.sql
