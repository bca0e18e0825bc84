"""Sales by item, place, channel and time; scores and ranks of items and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.arith import pct_change, r, ratio
from tessera.operators import relational as R
from tessera.plans import star
from tessera.plans.book import Book
from tessera.plans.star import money
from tessera.sources.catalog import table

book = Book(star.SQL)


def _by(df: DataFrame, *keys: str) -> DataFrame:
    """Revenue, units and distinct orders per key: lines are added up per order first, so the orders need no second distinct pass."""
    per = df.groupBy(*keys, "order_id").agg(F.sum("total4").alias("t"), F.sum("qty").alias("q"))
    return per.groupBy(*keys).agg(money(F.sum("t")).alias("revenue"), F.count("*").alias("order_count"), F.sum("q").alias("units_sold"))


_BY = "sum(total4)::bigint / 10000.0 revenue, count(distinct order_id) order_count, sum(qty)::bigint units_sold"


def _all_lines(spark: SparkSession, folder: str) -> DataFrame:
    return star.lines(spark, folder).join(star.orders(spark, folder, None), "order_id")


@book.add(f"select location, {_BY} from lines join orders_ using (order_id) join places using (customer_id) group by 1")
def sql_location(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue, orders and units per nation, all statuses, by Spark SQL over frames that are named in the text."""
    return spark.sql(
        "select location, cast(sum(total4) / 10000d as double) revenue, count(distinct order_id) order_count, sum(qty) units_sold"
        " from {lines} join (select * from {orders} join {places} using (customer_id)) using (order_id) group by location",
        lines=star.lines(spark, folder), orders=star.orders(spark, folder, None), places=star.places(spark, folder),
    )


@book.add(f"select channel, {_BY} from lines join orders_ using (order_id) group by 1")
def sql_channel(spark: SparkSession, folder: str) -> DataFrame:
    return _by(_all_lines(spark, folder), "channel")


@book.add(f"select dayname(day) as weekday, {_BY} from lines join orders_ using (order_id) group by 1")
def sql_weekday(spark: SparkSession, folder: str) -> DataFrame:
    return _by(_all_lines(spark, folder).withColumn("weekday", F.date_format("day", "EEEE")), "weekday")


_ITEMS = """
per_item as (
  select item_id, sum(qty)::bigint units, sum(total4)::bigint t, sum(profit4)::bigint p, count(distinct order_id) n_orders, count(distinct customer_id) n_customers,
    sum(gross4)::bigint g, sum(gross4 - total4)::bigint d from sales group by 1
), waste as (
  select item_id, sum(qty * discount2)::bigint wasted2, sum(qty)::bigint prepared from lines where flag = 'R' group by 1
)
"""


def _per_item(spark: SparkSession, folder: str) -> DataFrame:
    """One pass: lines added up per item and order, then per item; customers follow from orders (an order has one)."""
    s = star.sales(spark, folder, "item_id", "customer_id", "order_id", "qty", "total4", "profit4", "gross4")
    per = s.groupBy("item_id", "customer_id", "order_id").agg(F.sum("qty").alias("q"), F.sum("total4").alias("t"), F.sum("profit4").alias("p"), F.sum("gross4").alias("g"))
    cust = per.groupBy("item_id", "customer_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "qtpg"])
    return cust.groupBy("item_id").agg(
        F.sum("q").alias("units"), F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("n").alias("n_orders"), F.count("*").alias("n_customers"), F.count(F.when(F.col("n") >= 2, 1)).alias("n_repeat"), F.sum("g").alias("g"), (F.sum("g") - F.sum("t")).alias("d")
    )


def _waste(spark: SparkSession, folder: str) -> DataFrame:
    return star.lines(spark, folder).where("flag = 'R'").groupBy("item_id").agg(F.sum(F.col("qty") * F.col("discount2")).alias("wasted2"), F.sum("qty").alias("prepared"))


@book.add(
    """select item_id, brand, category, coalesce(units, 0)::bigint units_sold, coalesce(t, 0) / 10000.0 revenue, coalesce(p, 0) / 10000.0 profit, round(p * 100.0 / nullif(t, 0), 6) margin_percentage,
    round(wasted2 / 100.0, 2) quantity_wasted, prepared::bigint preparation_quantity, round(wasted2 / nullif(prepared, 0)::double, 6) wastage_percentage,
    row_number() over (order by coalesce(units, 0) desc, item_id)::bigint rank_units, row_number() over (order by coalesce(t, 0) desc, item_id)::bigint rank_revenue
    from items left join per_item using (item_id) left join waste using (item_id)""",
    _ITEMS,
)
def eda_item_rankings(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of the menu with its sales (0 where none), margins, wastage, and its ranks."""
    out = star.items(spark, folder).join(_per_item(spark, folder), "item_id", "left").join(_waste(spark, folder), "item_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "item_id")).cast("bigint")  # noqa: E731  items are a dimension
    out = out.withColumns({"units_sold": zero("units"), "t0": zero("t"), "rank_by": zero("t")})
    return out.select(
        "item_id", "brand", "category", "units_sold", money(F.col("t0")).alias("revenue"), money(zero("p")).alias("profit"), r(ratio("p", "t", 100)).alias("margin_percentage"), r(F.col("wasted2") / 100.0, 2).alias("quantity_wasted"),
        F.col("prepared").alias("preparation_quantity"), r(ratio("wasted2", "prepared")).alias("wastage_percentage"), rank("units_sold").alias("rank_units"), rank("rank_by").alias("rank_revenue"),
    )


@book.add("select category, sum(qty)::bigint units_sold, sum(total4)::bigint / 10000.0 revenue, round(sum(profit4) * 100.0 / nullif(sum(total4), 0), 6) margin_percentage from sales group by 1")
def eda_categories(spark: SparkSession, folder: str) -> DataFrame:
    s = star.sales(spark, folder, "category", "qty", "total4", "profit4").groupBy("category").agg(F.sum("qty").alias("units_sold"), F.sum("total4").alias("t"), F.sum("profit4").alias("p"))
    return s.select("category", "units_sold", money(F.col("t")).alias("revenue"), r(ratio("p", "t", 100)).alias("margin_percentage"))


@book.add(
    """select 'hour' period_type, extract(hour from ts)::varchar period, count(*) event_count from events group by all
    union all select 'weekday', dayname(ts), count(*) from events group by all"""
)
def eda_peak_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and per weekday, in one pass with grouping sets."""
    e = table(spark, folder, "events").select(F.hour("ts").cast("string").alias("h"), F.date_format("ts", "EEEE").alias("d"))
    both = spark.sql("select h, d, grouping(h) g, count(*) event_count from {events} group by grouping sets ((h), (d))", events=e)
    return both.select(F.when(F.col("g") == 0, "hour").otherwise("weekday").alias("period_type"), F.coalesce("h", "d").alias("period"), "event_count")


@book.add(f"select location, {_BY} from sales group by 1")
def eda_location(spark: SparkSession, folder: str) -> DataFrame:
    return _by(star.sales(spark, folder, "location", "order_id", "total4", "qty"), "location")


@book.add(f"select channel, {_BY} from sales group by 1")
def eda_channel(spark: SparkSession, folder: str) -> DataFrame:
    return _by(star.sales(spark, folder, "channel", "order_id", "total4", "qty"), "channel")


@book.add(f"select (discount2 >= 8)::boolean discounted, {_BY} from sales group by 1")
def eda_promotion(spark: SparkSession, folder: str) -> DataFrame:
    return _by(star.sales(spark, folder, "discount2", "order_id", "total4", "qty").withColumn("discounted", F.col("discount2") >= 8), "discounted")


@book.add(
    """select i.item_id, t / 10000.0 revenue, (t - p) / 10000.0 total_cost, p / 10000.0 margin, n_orders order_frequency, units popularity, round(p * 100.0 / nullif(t, 0), 6) profit_percentage,
    round(d * 100.0 / nullif(g, 0), 6) discount_percentage, round(n_repeat::double / n_customers, 6) repeat_rate, round(weekend / n_orders::double, 6) weekend_ratio, round(basket / lines_, 6) basket_size
    from per_item i
    join (select item_id, count(*) filter (n >= 2) n_repeat from (select item_id, customer_id, count(distinct order_id) n from sales group by all) group by 1) using (item_id)
    join (select item_id, count(distinct case when dayofweek(day) in (0, 6) then order_id end) weekend, sum(size) as basket, count(*) lines_
      from sales join (select order_id, count(distinct item_id) size from sales group by 1) using (order_id) group by 1) using (item_id)""",
    _ITEMS,
)
def menu_features(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: money, frequency, discount, repeat customers, weekend share, and the mean basket of its lines."""
    s = star.sales(spark, folder, "order_id", "item_id", "day")
    per_order = s.groupBy("order_id", "item_id", "day").agg(F.count("*").alias("lines"))
    sizes = F.count("*").over(Window.partitionBy("order_id"))
    sized = per_order.withColumn("size", sizes).groupBy("item_id").agg(
        F.sum(F.col("size") * F.col("lines")).alias("basket"), F.sum("lines").alias("n_lines"), F.count(F.when(F.dayofweek("day").isin(1, 7), 1)).alias("weekend")
    )
    out = _per_item(spark, folder).join(sized, "item_id")
    return out.select(
        "item_id", money(F.col("t")).alias("revenue"), money(F.col("t") - F.col("p")).alias("total_cost"), money(F.col("p")).alias("margin"), F.col("n_orders").alias("order_frequency"), F.col("units").alias("popularity"),
        r(ratio("p", "t", 100)).alias("profit_percentage"), r(ratio("d", "g", 100)).alias("discount_percentage"), r(ratio("n_repeat", "n_customers")).alias("repeat_rate"), r(ratio("weekend", "n_orders")).alias("weekend_ratio"),
        r(ratio("basket", "n_lines")).alias("basket_size"),
    )


_CUST = """
per_order as (select customer_id, order_id, any_value(day) as day, any_value(channel) channel, sum(total4)::bigint t from sales group by customer_id, order_id),
per_customer as (select customer_id, count(*) n, sum(t)::bigint t, max(day) last_day, min(day) first_day, count(distinct day) visit_days from per_order group by 1),
end_ as (select max(day) d from per_order)
"""


def _per_customer(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s = star.sales(spark, folder, "customer_id", "order_id", "day", "channel", "total4")
    per_order = s.groupBy("customer_id", "order_id", "day", "channel").agg(F.sum("total4").alias("t"))
    per_day = per_order.groupBy("customer_id", "day").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    per = per_day.groupBy("customer_id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.max("day").alias("last_day"), F.min("day").alias("first_day"), F.count("*").alias("visit_days"))
    return per_order, per


def _with_end(df: DataFrame, per: DataFrame, column: str = "last_day") -> DataFrame:
    return df.crossJoin(F.broadcast(per.agg(F.max(column).alias("end_day"))))  # one row


@book.add(
    """select customer_id, datediff('day', last_day, d)::bigint recency, n frequency, t / 10000.0 monetary, t / 10000.0 / n average_order_value, pref channel_preference
    from per_customer cross join end_ join (select customer_id, channel pref from (select customer_id, channel, row_number() over (partition by customer_id order by c desc, channel) k from (select customer_id, channel, count(*) c from per_order group by all)) where k = 1) using (customer_id)""",
    _CUST,
)
def customer_features(spark: SparkSession, folder: str) -> DataFrame:
    """Recency, frequency, monetary value, mean order value and preferred channel per customer."""
    orders, per = _per_customer(spark, folder)
    pref = R.top_n(orders.groupBy("customer_id", "channel").agg(F.count("*").alias("c")), ["customer_id"], [F.desc("c"), F.asc("channel")], 1)
    return _with_end(per, per).join(pref, "customer_id").select(
        "customer_id", F.datediff("end_day", "last_day").cast("bigint").alias("recency"), F.col("n").alias("frequency"), money(F.col("t")).alias("monetary"), (money(F.col("t")) / F.col("n")).alias("average_order_value"),
        F.col("channel").alias("channel_preference"),
    )


@book.add("select item_id, location, sum(total4)::bigint / 10000.0 revenue, round(sum(total4) * 100.0 / sum(sum(total4)) over (partition by location), 6) share_pct from sales group by item_id, location")
def item_location_share(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue of an item at a location and its share of the location's."""
    per = star.sales(spark, folder, "item_id", "location", "total4").groupBy("item_id", "location").agg(F.sum("total4").alias("t"))
    whole = per.groupBy("location").agg(F.sum("t").alias("all"))  # not a window: a location may hold a third of all rows
    return per.join(whole, "location").select("item_id", "location", money(F.col("t")).alias("revenue"), r(ratio("t", "all", 100)).alias("share_pct"))


_CLASS = """
scored as (
  select item_id, t / 10000.0 margin_base, p, units, n_orders, wasted2 / nullif(prepared, 0)::double wastage,
    percent_rank() over (order by p asc nulls first) pr_margin, percent_rank() over (order by round(p * 100.0 / nullif(t, 0), 9) asc nulls first) pr_pct,
    percent_rank() over (order by units asc nulls first) pr_units, percent_rank() over (order by n_orders asc nulls first) pr_freq,
    case when wasted2 is not null then percent_rank() over (order by round(wasted2 / nullif(prepared, 0)::double, 9) asc nulls first) end pr_waste
  from per_item left join waste using (item_id)
), final_ as (
  select item_id, round((pr_margin + pr_pct) / 2, 6) profitability, round((pr_units + pr_freq) / 2, 6) demand, coalesce(pr_waste <= 0.75, true) acceptable from scored
)
"""


def _scores(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Percent ranks of margin, margin share, units, frequency and wastage among all items (a dimension), or per key."""
    out = df.withColumn("pct", F.round(ratio("p", "t", 100), 9)).withColumn("waste", F.round(ratio("wasted2", "prepared"), 9))
    for value, name in (("p", "pr_margin"), ("pct", "pr_pct"), ("units", "pr_units"), ("n_orders", "pr_freq"), ("waste", "pr_waste")):
        out = R.percent_rank(out, value, name, keys)
    return out


@book.add(
    """select item_id, profitability, demand, acceptable acceptable_wastage, case when profitability >= 0.6 and demand >= 0.4 and acceptable then 'high profit' when demand >= 0.6 then 'high volume' else 'other' end as class from final_""",
    _ITEMS + "," + _CLASS,
)
def menu_class(spark: SparkSession, folder: str) -> DataFrame:
    """Items scored by percent ranks; ranks of missing values stay null but count in the population."""
    out = _scores(_per_item(spark, folder).join(_waste(spark, folder), "item_id", "left"))
    out = out.select("item_id", r((F.col("pr_margin") + F.col("pr_pct")) / 2).alias("profitability"), r((F.col("pr_units") + F.col("pr_freq")) / 2).alias("demand"), F.coalesce(F.col("pr_waste") <= 0.75, F.lit(True)).alias("acceptable_wastage"))
    high = (F.col("profitability") >= 0.6) & (F.col("demand") >= 0.4) & F.col("acceptable_wastage")
    return out.withColumn("class", F.when(high, "high profit").when(F.col("demand") >= 0.6, "high volume").otherwise("other"))


@book.add(
    """select item_id, count(*) active_months, round(sum(units) filter (k <= 3) / sum(units)::double, 6) top3_share
    from (select item_id, units, row_number() over (partition by item_id order by units desc, m) k from (select item_id, date_trunc('month', day)::date m, sum(qty) units from sales group by all)) group by 1"""
)
def item_seasonality(spark: SparkSession, folder: str) -> DataFrame:
    """Months with sales and the share of the three best."""
    per = star.sales(spark, folder, "item_id", "day", "qty").groupBy("item_id", F.trunc("day", "month").alias("m")).agg(F.sum("qty").alias("units"))
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("units"), "m"))
    return per.withColumn("k", k).groupBy("item_id").agg(F.count("*").alias("active_months"), r(F.sum(F.when(F.col("k") <= 3, F.col("units"))) / F.sum("units")).alias("top3_share"))


@book.add("select item_id, count(*) locations, round(stddev_pop(t / 10000.0) / avg(t / 10000.0), 6) variation from (select item_id, location, sum(total4)::bigint t from sales group by all) group by 1")
def location_variability(spark: SparkSession, folder: str) -> DataFrame:
    per = star.sales(spark, folder, "item_id", "location", "total4").groupBy("item_id", "location").agg(F.sum("total4").alias("t"))
    return per.groupBy("item_id").agg(F.count("*").alias("locations"), r(F.stddev_pop(money(F.col("t"))) / F.avg(money(F.col("t")))).alias("variation"))


_RFM = """
rfm as (
  select customer_id, datediff('day', last_day, d) recency, coalesce(n, 0) n, coalesce(t, 0) t, visit_days, first_day, last_day, d,
    case when last_day is not null then 6 - ntile(5) over (order by datediff('day', last_day, d) asc nulls last, customer_id) end r,
    6 - ntile(5) over (order by coalesce(n, 0) desc, customer_id) f, 6 - ntile(5) over (order by coalesce(t, 0) desc, customer_id) m
  from (select c_custkey customer_id from customer) left join per_customer using (customer_id) cross join end_
)
"""


def _rfm(spark: SparkSession, folder: str) -> DataFrame:
    """Fifths of all customers by recency, frequency and money, from positions in a distributed sort: customers grow with the data."""
    _, per = _per_customer(spark, folder)
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id")).join(per, "customer_id", "left")
    c = _with_end(c, per).withColumns({"recency": F.datediff("end_day", "last_day").cast("bigint"), "n": F.coalesce("n", F.lit(0)), "t": F.coalesce("t", F.lit(0))})
    c = R.tiles(c, "customer_id", {"r": F.coalesce("recency", F.lit(2**62)), "f": -F.col("n"), "m": -F.col("t")}, 5)
    return c.withColumns({"r": F.when(F.col("last_day").isNotNull(), 6 - F.col("r")), "f": 6 - F.col("f"), "m": 6 - F.col("m")})


@book.add("select customer_id, recency::bigint recency_days, n::bigint frequency, t / 10000.0 monetary_value, r::bigint r_score, f::bigint f_score, m::bigint m_score from rfm", _CUST + "," + _RFM)
def customer_rfm(spark: SparkSession, folder: str) -> DataFrame:
    return _rfm(spark, folder).select("customer_id", F.col("recency").alias("recency_days"), F.col("n").alias("frequency"), money(F.col("t")).alias("monetary_value"), F.col("r").alias("r_score"), F.col("f").alias("f_score"), F.col("m").alias("m_score"))


@book.add(
    """select segment, count(*) customers, round(count(*) * 100.0 / sum(count(*)) over (), 6) share_pct from (
      select case when n <= 1 then 'single' when r <= 2 then 'lapsing' when f >= 4 and m >= 4 then 'best' when f >= 4 then 'frequent' else 'occasional' end segment from rfm) group by 1""",
    _CUST + "," + _RFM,
)
def customer_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by the first matching segment, with shares."""
    seg = F.when(F.col("n") <= 1, "single").when(F.col("r") <= 2, "lapsing").when((F.col("f") >= 4) & (F.col("m") >= 4), "best").when(F.col("f") >= 4, "frequent").otherwise("occasional")
    per = _rfm(spark, folder).groupBy(seg.alias("segment")).agg(F.count("*").alias("customers"))
    return per.withColumn("share_pct", r(F.col("customers") * 100.0 / F.sum("customers").over(Window.partitionBy())))


@book.add(
    """select customer_id, count(*) filter (age < 730) recent_orders, count(*) filter (age >= 730 and age < 1460) prior_orders, coalesce(sum(t) filter (age < 730), 0)::bigint / 10000.0 recent_money, coalesce(sum(t) filter (age >= 730 and age < 1460), 0)::bigint / 10000.0 prior_money,
      min(age)::bigint recency_days, round((count(*) filter (age < 730) - count(*) filter (age >= 730 and age < 1460)) * 100.0 / nullif(count(*) filter (age >= 730 and age < 1460), 0), 6) trend_pct
    from (select customer_id, t, datediff('day', day, d) age from per_order cross join end_) group by 1""",
    _CUST,
)
def customer_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Two adjacent windows of activity per customer, by conditional aggregates in one pass."""
    orders, per = _per_customer(spark, folder)
    o = _with_end(orders, per).withColumn("age", F.datediff("end_day", "day"))
    recent, prior = F.col("age") < 730, (F.col("age") >= 730) & (F.col("age") < 1460)
    agg = o.groupBy("customer_id").agg(
        F.count(F.when(recent, 1)).alias("recent_orders"), F.count(F.when(prior, 1)).alias("prior_orders"), money(F.sum(F.when(recent, F.col("t")).otherwise(0))).alias("recent_money"), money(F.sum(F.when(prior, F.col("t")).otherwise(0))).alias("prior_money"),
        F.min("age").cast("bigint").alias("recency_days"),
    )
    return agg.withColumn("trend_pct", r(pct_change("recent_orders", "prior_orders")))


@book.add("select extract(hour from ts)::bigint order_hour, count(*) event_count, count(distinct user_id) users, sum(round(value * 100)::bigint)::bigint / 100.0 / count(*) mean_value from events group by 1")
def hourly_activity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.hour("ts").cast("bigint").alias("order_hour")).agg(F.count("*").alias("event_count"), F.count_distinct("user_id").alias("users"), (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0 / F.count("*")).alias("mean_value"))


@book.add("select (dayofweek(day) + 1)::bigint day_number, dayname(day) day_name, count(*) order_count, sum(value2)::bigint / 100.0 revenue from done group by all")
def weekday_pattern(spark: SparkSession, folder: str) -> DataFrame:
    o = star.orders(spark, folder)
    return o.groupBy(F.dayofweek("day").cast("bigint").alias("day_number"), F.date_format("day", "EEEE").alias("day_name")).agg(F.count("*").alias("order_count"), (F.sum("value2") / 100.0).cast("double").alias("revenue"))


@book.add("select month(day)::bigint month_number, monthname(day) month_name, count(distinct year(day)) years_observed, count(*) order_count, sum(value2)::bigint / 100.0 revenue from done group by all")
def seasonal_pattern(spark: SparkSession, folder: str) -> DataFrame:
    o = star.orders(spark, folder)
    return o.groupBy(F.month("day").cast("bigint").alias("month_number"), F.date_format("day", "MMMM").alias("month_name")).agg(F.count_distinct(F.year("day")).alias("years_observed"), F.count("*").alias("order_count"), (F.sum("value2") / 100.0).cast("double").alias("revenue"))


@book.add(
    """select year_month, order_count, revenue, round((revenue - lag(revenue) over w) * 100.0 / lag(revenue) over w, 6) change_pct, round(avg(revenue) over (order by year_month rows between 2 preceding and current row), 6) mean_3
    from (select strftime(day, '%Y-%m') year_month, count(*) order_count, sum(value2)::bigint / 100.0 revenue from done group by 1) window w as (order by year_month)"""
)
def monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and revenue per month, the change on the month before, and the mean of three."""
    per = star.orders(spark, folder).groupBy(F.date_format("day", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("order_count"), (F.sum("value2") / 100.0).cast("double").alias("revenue"))
    w = Window.orderBy("year_month")  # one row a month
    before = F.lag("revenue").over(w)
    return per.select("year_month", "order_count", "revenue", r((F.col("revenue") - before) * 100.0 / before).alias("change_pct"), r(F.avg("revenue").over(w.rowsBetween(-2, 0))).alias("mean_3"))


@book.add(
    """select * from (select 'month' period_type, monthname(day) peak_period, count(*) order_count from done group by all order by 3 desc, 2 limit 1)
    union all select * from (select 'weekday', dayname(day), count(*) from done group by all order by 3 desc, 2 limit 1)
    union all select * from (select 'location', location, count(*) from done join places using (customer_id) group by all order by 3 desc, 2 limit 1)
    union all select * from (select 'channel', channel, count(*) from done group by all order by 3 desc, 2 limit 1)"""
)
def peak_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The busiest month, weekday, location and channel: a top-k report, from one count per combination."""
    o = star.orders(spark, folder).join(star.places(spark, folder), "customer_id").groupBy(F.date_format("day", "MMMM").alias("month"), F.date_format("day", "EEEE").alias("weekday"), "location", "channel").agg(F.count("*").alias("n"))
    long = o.select("n", F.explode(F.create_map(*[x for k in ("month", "weekday", "location", "channel") for x in (F.lit(k), F.col(k))])).alias("period_type", "peak_period"))
    per = long.groupBy("period_type", "peak_period").agg(F.sum("n").alias("order_count"))
    return R.top_n(per, ["period_type"], [F.desc("order_count"), F.asc("peak_period")], 1).drop("rank")


@book.add(
    """select location, count(*) order_count, sum(t)::bigint / 10000.0 revenue, sum(p)::bigint / 10000.0 margin, sum(t)::bigint / 10000.0 / count(*) average_order_value, count(distinct customer_id) customers,
      round(avg((disc > 0)::int) * 100, 6) discounted_share from (select location, order_id, any_value(customer_id) customer_id, sum(total4) t, sum(profit4) p, count(*) filter (discount2 >= 8) disc from sales group by all) group by 1"""
)
def location_comparison(spark: SparkSession, folder: str) -> DataFrame:
    per = star.sales(spark, folder, "location", "customer_id", "order_id", "total4", "profit4", "discount2").groupBy("location", "customer_id", "order_id").agg(F.sum("total4").alias("t"), F.sum("profit4").alias("p"), F.max((F.col("discount2") >= 8).cast("int")).alias("disc"))
    cust = per.groupBy("location", "customer_id").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("disc").alias("disc"))
    out = cust.groupBy("location").agg(F.sum("n").alias("order_count"), F.sum("t").alias("t"), F.sum("p").alias("p"), F.count("*").alias("customers"), F.sum("disc").alias("d"))
    return out.select("location", "order_count", money(F.col("t")).alias("revenue"), money(F.col("p")).alias("margin"), (money(F.col("t")) / F.col("order_count")).alias("average_order_value"), "customers", r(ratio("d", "order_count", 100)).alias("discounted_share"))


@book.add(
    """select location, brand, revenue, round(percent_rank() over (partition by location order by p asc nulls first, brand), 6) profit_rank, round(percent_rank() over (partition by location order by units asc nulls first, brand), 6) demand_rank
    from (select location, brand, sum(total4)::bigint / 10000.0 revenue, sum(profit4)::bigint p, sum(qty)::bigint units from sales group by all)"""
)
def location_menu(spark: SparkSession, folder: str) -> DataFrame:
    """Brands ranked within each location, over the aggregated rows."""
    per = star.sales(spark, folder, "location", "brand", "total4", "profit4", "qty").groupBy("location", "brand").agg(money(F.sum("total4")).alias("revenue"), F.sum("profit4").alias("p"), F.sum("qty").alias("units"))
    per = R.percent_rank(R.percent_rank(per, "p", "a", ["location"], "brand"), "units", "b", ["location"], "brand")
    return per.select("location", "brand", "revenue", r(F.col("a")).alias("profit_rank"), r(F.col("b")).alias("demand_rank"))


@book.add(
    """select channel, count(*) order_count, sum(t)::bigint / 10000.0 revenue, round(sum(p) * 100.0 / sum(t), 6) margin_pct, round(avg(size), 6) basket_size, count(distinct customer_id) customers
    from (select channel, order_id, any_value(customer_id) customer_id, sum(total4) t, sum(profit4) p, count(distinct item_id) size from sales group by all) group by 1"""
)
def channel_summary(spark: SparkSession, folder: str) -> DataFrame:
    per = star.sales(spark, folder, "channel", "customer_id", "order_id", "item_id", "total4", "profit4").groupBy("channel", "customer_id", "order_id", "item_id").agg(F.sum("total4").alias("t"), F.sum("profit4").alias("p"))
    per = per.groupBy("channel", "customer_id", "order_id").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.count("*").alias("size"))
    out = per.groupBy("channel").agg(F.count("*").alias("order_count"), F.sum("t").alias("t"), F.sum("p").alias("p"), F.avg("size").alias("s"), F.count_distinct("customer_id").alias("customers"))
    return out.select("channel", "order_count", money(F.col("t")).alias("revenue"), r(ratio("p", "t", 100)).alias("margin_pct"), r(F.col("s")).alias("basket_size"), "customers")


@book.add("select channel, category, revenue, row_number() over (partition by channel order by revenue desc, category)::bigint as rank from (select channel, category, sum(total4)::bigint / 10000.0 revenue from sales group by all)")
def channel_category(spark: SparkSession, folder: str) -> DataFrame:
    per = star.sales(spark, folder, "channel", "category", "total4").groupBy("channel", "category").agg(money(F.sum("total4")).alias("revenue"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("revenue"), "category")).cast("bigint"))


@book.add(
    """select channel, year_month, order_count, k::bigint as rank from (select *, row_number() over (partition by channel order by order_count desc, year_month) k from (select channel, strftime(day, '%Y-%m') year_month, count(*) order_count from done group by all)) where k <= 3"""
)
def channel_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """The three busiest months of each channel: a top-k report."""
    per = star.orders(spark, folder).groupBy("channel", F.date_format("day", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("order_count"))
    return R.top_n(per, ["channel"], [F.desc("order_count"), F.asc("year_month")], 3).withColumn("rank", F.col("rank").cast("bigint"))


@book.add("select a.antecedent, a.consequent, a.pair_count, round(a.support, 9) support, round(a.confidence, 9) confidence, round(a.lift, 6) lift from rules_ a",
    """held as (select distinct order_id, item_id from sales), n_ as (select count(distinct order_id) n from held), single as (select item_id, count(*) c from held group by 1),
    pairs as (select x.item_id a, y.item_id b, count(*) pair_count from held x join held y on x.order_id = y.order_id and x.item_id <> y.item_id group by all having count(*) >= 2),
    rules_ as (select a antecedent, b consequent, pair_count, pair_count / n::double support, pair_count / s.c::double confidence, pair_count::double * n / (s.c * t.c) lift from pairs join single s on s.item_id = a join single t on t.item_id = b cross join n_)""")  # fmt: skip
def association_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules between items of completed orders, in both directions."""
    o = star.lines(spark, folder).select("order_id", "item_id").join(star.orders(spark, folder).select("order_id"), "order_id", "left_semi")
    return R.rules(o, "order_id", "item_id").withColumns({"support": r(F.col("support"), 9), "confidence": r(F.col("confidence"), 9), "lift": r(F.col("lift"))})


@book.add(
    """select antecedent, consequent, recommendation_rank, lift, case when i.category = j.category and j.cost2 > i.cost2 then 'dearer, same kind' when i.category = j.category then 'same kind' else 'other kind' end relation from (
      select antecedent, consequent, round(lift, 6) lift, row_number() over (partition by antecedent order by round(lift, 6) desc, round(confidence, 9) desc, pair_count desc, consequent)::bigint recommendation_rank from rules_)
    join items i on i.item_id = antecedent join items j on j.item_id = consequent where recommendation_rank <= 5""",
    """held as (select distinct order_id, item_id from sales), n_ as (select count(distinct order_id) n from held), single as (select item_id, count(*) c from held group by 1),
    pairs as (select x.item_id a, y.item_id b, count(*) pair_count from held x join held y on x.order_id = y.order_id and x.item_id <> y.item_id group by all having count(*) >= 2),
    rules_ as (select a antecedent, b consequent, pair_count, pair_count / n::double support, pair_count / s.c::double confidence, pair_count::double * n / (s.c * t.c) lift from pairs join single s on s.item_id = a join single t on t.item_id = b cross join n_)""",
)
def bundle_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five strongest partners of each item, with how the two relate: a top-k report."""
    top = R.top_n(association_rules(spark, folder), ["antecedent"], [F.desc("lift"), F.desc("confidence"), F.desc("pair_count"), F.asc("consequent")], 5, "recommendation_rank")
    i = star.items(spark, folder)
    a, b = (i.select(F.col("item_id").alias(k), F.col("category").alias(f"c_{k}"), F.col("cost2").alias(f"p_{k}")) for k in ("antecedent", "consequent"))
    same = F.col("c_antecedent") == F.col("c_consequent")
    rel = F.when(same & (F.col("p_consequent") > F.col("p_antecedent")), "dearer, same kind").when(same, "same kind").otherwise("other kind")
    return top.join(a, "antecedent").join(b, "consequent").select("antecedent", "consequent", F.col("recommendation_rank").cast("bigint").alias("recommendation_rank"), "lift", rel.alias("relation"))


def _waste_lines(spark: SparkSession, folder: str) -> DataFrame:
    w = star.lines(spark, folder).where("flag = 'R'").join(star.items(spark, folder).select("item_id", "category", "cost2"), "item_id")
    return w.select("item_id", "category", "supplier_id", "unit", "ship_day", "qty", (F.col("qty") * F.col("discount2")).alias("wasted2"), (F.col("qty") * F.col("discount2") * F.col("cost2")).alias("cost4"))


_WASTE = """waste_ as (select item_id, category, supplier_id, unit, ship_day, qty, qty * discount2 wasted2, qty * discount2 * cost2 cost4 from lines join items using (item_id) where flag = 'R')"""
_WASTE_COLUMNS = "sum(wasted2)::bigint / 100.0 quantity_wasted, sum(cost4)::bigint / 10000.0 wastage_cost, sum(qty)::bigint preparation_quantity, count(*) record_count, round(sum(wasted2) / nullif(sum(qty), 0)::double, 6) wastage_percentage"


def _waste_by(spark: SparkSession, folder: str, *keys: Column | str) -> DataFrame:
    """Quantities add up only within a unit, so the unit is part of every key."""
    out = _waste_lines(spark, folder).groupBy(*keys, "unit").agg(F.sum("wasted2").alias("w"), F.sum("cost4").alias("c"), F.sum("qty").alias("q"), F.count("*").alias("record_count"))
    names = [c for c in out.columns if c not in "wcq" and c != "record_count"]
    return out.select(*names, (F.col("w") / 100.0).cast("double").alias("quantity_wasted"), money(F.col("c")).alias("wastage_cost"), F.col("q").alias("preparation_quantity"), "record_count", r(ratio("w", "q")).alias("wastage_percentage"))


@book.add(f"select item_id, unit, {_WASTE_COLUMNS} from waste_ group by all", _WASTE)
def wastage_by_item(spark: SparkSession, folder: str) -> DataFrame:
    return _waste_by(spark, folder, "item_id")


@book.add(f"select supplier_id, unit, {_WASTE_COLUMNS} from waste_ group by all", _WASTE)
def wastage_by_location(spark: SparkSession, folder: str) -> DataFrame:
    return _waste_by(spark, folder, "supplier_id")


@book.add(f"select category, unit, {_WASTE_COLUMNS} from waste_ group by all", _WASTE)
def wastage_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return _waste_by(spark, folder, "category")


@book.add(f"select strftime(ship_day, '%Y-%m') as month, unit, {_WASTE_COLUMNS} from waste_ group by all", _WASTE)
def wastage_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return _waste_by(spark, folder, F.date_format("ship_day", "yyyy-MM").alias("month"))


@book.add(f"select dayname(ship_day) as day_name, unit, {_WASTE_COLUMNS} from waste_ group by all", _WASTE)
def wastage_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return _waste_by(spark, folder, F.date_format("ship_day", "EEEE").alias("day_name"))


@book.add(
    """select item_id, risk_score, round(cutoff, 4) cutoff, risk_score >= round(cutoff, 4) high_risk from (select item_id, round(sum(wasted2) / nullif(sum(qty), 0)::double, 6) risk_score from waste_ group by 1)
    cross join (select quantile_cont(r, 0.75) cutoff from (select round(sum(wasted2) / nullif(sum(qty), 0)::double, 6) r from waste_ group by item_id))""",
    _WASTE,
)
def wastage_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Items above the exact third quartile of wastage; the cut-off stays lazy as a one-row join."""
    per = _waste_lines(spark, folder).groupBy("item_id").agg(r(F.sum("wasted2") / F.sum("qty")).alias("risk_score"))
    cut = per.agg(F.percentile("risk_score", F.lit(0.75)).alias("c"))
    return per.crossJoin(F.broadcast(cut)).select("item_id", "risk_score", r(F.col("c"), 4).alias("cutoff"), (F.col("risk_score") >= r(F.col("c"), 4)).alias("high_risk"))


@book.add(
    """select metric, round(value, 4) as value from (select count(*)::double orders, sum(value2) / 100.0 revenue, avg(value2) / 100.0 mean_order, count(distinct customer_id)::double customers, max(value2) / 100.0 largest from done)
    unpivot (value for metric in (orders, revenue, mean_order, customers, largest))"""
)
def kpi_executive(spark: SparkSession, folder: str) -> DataFrame:
    """Key figures, one row each."""
    one = star.orders(spark, folder).agg(F.count("*").alias("orders"), (F.sum("value2") / 100.0).alias("revenue"), (F.avg("value2") / 100.0).alias("mean_order"), F.count_distinct("customer_id").alias("customers"), (F.max("value2") / 100.0).alias("largest"))
    return R.unpivot(one, [], ["orders", "revenue", "mean_order", "customers", "largest"]).withColumn("value", r(F.col("value"), 4))


QUERIES, SQL = book.queries, book.sql
