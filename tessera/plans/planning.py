"""Effects of prices and campaigns, anomalies and forecasts of many series, classes and flags of items, signs of leaving customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.arith import pct_change, r, ratio
from tessera.functions.calendar import season
from tessera.operators import relational as R
from tessera.plans import sales, star, temporal
from tessera.plans.book import Book
from tessera.plans.star import money
from tessera.sources.catalog import table

book = Book(star.SQL)


def _no(c: str | Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def _sum(cond: Column, c: str) -> Column:
    return F.sum(F.when(cond, F.col(c)).otherwise(0))


#: Days on either side of a price change.
PRICE_WINDOW = 60
_CLASS_OF = "case when {0} is null then 'Insufficient' when abs({0}) >= 1.5 then 'High' when abs({0}) >= 0.75 then 'Moderate' else 'Low' end"


@book.add(
    f"""select *, {_CLASS_OF.format('elasticity')} sensitivity from (
      select item_id, since, previous4 / 10000.0 previous_price, price4 / 10000.0 new_price, u0::bigint units_before, u1::bigint units_after, t0 / 10000.0 revenue_before, t1 / 10000.0 revenue_after, p0 / 10000.0 margin_before, p1 / 10000.0 margin_after,
        d0 / 10000.0 discount_before, d1 / 10000.0 discount_after, days_before, days_after, round((price4 - previous4) * 100.0 / previous4, 6) price_change_pct, round((u1 - u0) * 100.0 / nullif(u0, 0), 6) demand_change_pct,
        round((t1 - t0) * 100.0 / nullif(t0, 0), 6) revenue_change_pct, round((p1 - p0) * 100.0 / nullif(p0, 0), 6) margin_change_pct,
        round(((u1 - u0) * 100.0 / nullif(u0, 0)) / nullif((price4 - previous4) * 100.0 / previous4, 0), 6) elasticity
      from (select item_id, since, previous4, price4, coalesce(sum(u) filter (day < since), 0)::bigint u0, coalesce(sum(u) filter (day >= since), 0)::bigint u1, coalesce(sum(t) filter (day < since), 0)::bigint t0, coalesce(sum(t) filter (day >= since), 0)::bigint t1,
          coalesce(sum(p) filter (day < since), 0)::bigint p0, coalesce(sum(p) filter (day >= since), 0)::bigint p1, coalesce(sum(d) filter (day < since), 0)::bigint d0, coalesce(sum(d) filter (day >= since), 0)::bigint d1,
          count(*) filter (day < since) days_before, count(*) filter (day >= since) days_after
        from price_events join (select item_id, day, sum(qty)::bigint u, sum(total4)::bigint t, sum(profit4)::bigint p, sum(gross4 - total4)::bigint d from sales group by all) using (item_id)
        where previous4 > 0 and price4 > 0 and day >= since - {PRICE_WINDOW} and day < since + {PRICE_WINDOW} group by all))""",
    temporal._PRICES,
)
def price_response(spark: SparkSession, folder: str) -> DataFrame:
    """Units, revenue, margin and discount before and after each change of an item's price, with elasticity and its class.

    Sales are added up by item and day before they meet the intervals, by bucket of days. Changes without a sale on either side are
    left out; a ratio is null where what it divides by is 0.
    """
    daily = star.sales(spark, folder, "item_id", "day", "qty", "total4", "profit4", "gross4").groupBy("item_id", "day").agg(
        F.sum("qty").alias("u"), F.sum("total4").alias("t"), F.sum("profit4").alias("p"), (F.sum("gross4") - F.sum("total4")).alias("d")
    )
    ev = temporal._price_events(spark, folder).where("previous4 > 0 and price4 > 0").select("item_id", "since", "previous4", "price4", (_no("since") - PRICE_WINDOW).alias("lo"), (_no("since") + PRICE_WINDOW - 1).alias("hi"))
    j = R.within_intervals(daily.withColumn("at", _no("day")), ev, ["item_id"], "at", "lo", "hi", bucket=2 * PRICE_WINDOW)
    early, late = F.col("day") < F.col("since"), F.col("day") >= F.col("since")
    s = j.groupBy("item_id", "since", "previous4", "price4").agg(
        *[_sum(when, c).alias(f"{c}{k}") for c in "utpd" for k, when in ((0, early), (1, late))], F.count(F.when(early, 1)).alias("days_before"), F.count(F.when(late, 1)).alias("days_after")
    )
    price, demand = pct_change("price4", "previous4"), pct_change("u1", "u0")
    e = F.col("elasticity")
    level = F.when(e.isNull(), "Insufficient").when(F.abs(e) >= 1.5, "High").when(F.abs(e) >= 0.75, "Moderate").otherwise("Low")
    return s.select(
        "item_id", "since", money(F.col("previous4")).alias("previous_price"), money(F.col("price4")).alias("new_price"), F.col("u0").alias("units_before"), F.col("u1").alias("units_after"), money(F.col("t0")).alias("revenue_before"),
        money(F.col("t1")).alias("revenue_after"), money(F.col("p0")).alias("margin_before"), money(F.col("p1")).alias("margin_after"), money(F.col("d0")).alias("discount_before"), money(F.col("d1")).alias("discount_after"), "days_before", "days_after",
        r(price).alias("price_change_pct"), r(demand).alias("demand_change_pct"), r(pct_change("t1", "t0")).alias("revenue_change_pct"), r(pct_change("p1", "p0")).alias("margin_change_pct"), r(demand / F.nullif(price, F.lit(0.0))).alias("elasticity"),
    ).withColumn("sensitivity", level)


_SPIKES = "case when units > mu + 3 * sd then 'spike' when units < mu - 3 * sd then 'drop' else 'unexpected' end"


@book.add(
    f"""select brand, region, day, units, round(mu, 6) baseline, round(sd, 6) spread, {_SPIKES} kind from (
      select *, avg(units) over w mu, stddev_pop(units) over w sd, count(*) over w n from panel window w as (partition by brand, region order by day rows between 28 preceding and 1 preceding))
    where n >= 7 and mu > 0 and (abs(units - mu) > 3 * sd or units >= 2 * mu)""",
    temporal._PANEL,
)
def panel_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Days of an item and place off their own 28-day baseline, on the gap-free panel: spikes, drops and unexpected highs."""
    s = temporal.panel(spark, folder).withColumn("no", _no("day"))
    w = Window.partitionBy("brand", "region").orderBy("no").rangeBetween(-28, -1)
    s = s.select("brand", "region", "day", F.col("units").cast("bigint").alias("units"), F.avg("units").over(w).alias("mu"), F.stddev_pop("units").over(w).alias("sd"), F.count("*").over(w).alias("n"))
    u, mu, sd = F.col("units"), F.col("mu"), F.col("sd")
    kind = F.when(u > mu + 3 * sd, "spike").when(u < mu - 3 * sd, "drop").otherwise("unexpected")
    return s.where((F.col("n") >= 7) & (mu > 0) & ((F.abs(u - mu) > 3 * sd) | (u >= 2 * mu))).select("brand", "region", "day", "units", r(mu).alias("baseline"), r(sd).alias("spread"), kind.alias("kind"))


_AHEAD = """
ahead as (
  select category, location, (last_ + h)::date as day, h::bigint horizon_day, f from (
    select category, location, last_, sum(units)::bigint / 7.0 f from (
      select *, max(day) over (partition by category, location) last_ from (select category, location, day, sum(qty)::bigint units from sales group by all)) where day > last_ - 7 group by all)
  cross join (select unnest(generate_series(1, 30))::int h)
)
"""


def _ahead(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty days ahead per category and place: the mean of the seven days up to its last one, days without a sale as 0."""
    daily = star.sales(spark, folder, "category", "location", "day", "qty").groupBy("category", "location", "day").agg(F.sum("qty").alias("units"))
    last = daily.groupBy("category", "location").agg(F.max("day").alias("last"))
    week = daily.join(last, ["category", "location"]).where(F.col("day") > F.date_sub("last", 7)).groupBy("category", "location", "last").agg((F.sum("units") / 7.0).alias("f"))
    out = week.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("day", F.date_add("last", F.col("h")))
    return out.select("category", "location", "day", F.col("h").cast("bigint").alias("horizon_day"), "f")


_FORECAST = """select {0}, day, round(sum(f), 6) forecast, dayofweek(day) in (0, 6) is_weekend, case when month(day) in (12, 1, 2) then 'Winter' when month(day) <= 5 then 'Spring' when month(day) <= 8 then 'Summer' else 'Autumn' end season,
  round(sum(f), 6) >= round(quantile_cont(sum(f), 0.75) over (partition by {0}), 6) peak from ahead group by {0}, day"""


def _forecast(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Sums of the finest forecasts; a day is a peak if it is in the upper quarter of its series, of at most some hundred days."""
    out = _ahead(spark, folder).groupBy(key, "day").agg(F.sum("f").alias("f"))
    cut_ = F.percentile("f", F.lit(0.75)).over(Window.partitionBy(key))
    return out.select(key, "day", r(F.col("f")).alias("forecast"), F.dayofweek("day").isin(1, 7).alias("is_weekend"), season("day").alias("season"), (r(F.col("f")) >= r(cut_)).alias("peak"))


@book.add(_FORECAST.format("category"), _AHEAD)
def forecast_category(spark: SparkSession, folder: str) -> DataFrame:
    return _forecast(spark, folder, "category")


@book.add(_FORECAST.format("location"), _AHEAD)
def forecast_location(spark: SparkSession, folder: str) -> DataFrame:
    return _forecast(spark, folder, "location")


def _campaigns(spark: SparkSession) -> DataFrame:
    c = spark.createDataFrame([(i, a, b) for i, a, b in temporal._CAMPAIGNS], "campaign_id int, starts string, ends string").withColumns({"starts": F.to_date("starts"), "ends": F.to_date("ends")})
    return c.withColumns({"lo": _no("starts") - 30, "hi": _no("ends")})


_EFFECT = (
    temporal._CAMPAIGN_SQL
    + """,
per_order as (select order_id, any_value(customer_id) customer_id, any_value(day) as day, sum(total4)::bigint t, sum(profit4)::bigint p from sales group by 1),
firsts as (select customer_id, min(day) first_day from per_order group by 1),
effect as (
  select campaign_id, count(*) filter (day >= starts) n1, count(*) filter (day < starts) n0, coalesce(sum(t) filter (day >= starts), 0)::bigint t1, coalesce(sum(t) filter (day < starts), 0)::bigint t0, coalesce(sum(p) filter (day >= starts), 0)::bigint p1,
    coalesce(sum(p) filter (day < starts), 0)::bigint p0, count(distinct customer_id) filter (day >= starts) c1, count(distinct customer_id) filter (day < starts) c0, count(distinct customer_id) filter (day >= starts and first_day = day) new_
  from per_order join firsts using (customer_id) join campaigns on day between starts - 30 and ends group by 1
)"""
)


@book.add(
    """select campaign_id, n1 orders_during, n0 orders_before, t1 / 10000.0 revenue_during, t0 / 10000.0 revenue_before, p1 / 10000.0 margin_during, p0 / 10000.0 margin_before, round(t1 / 10000.0 / nullif(n1, 0), 6) order_value_during, round(t0 / 10000.0 / nullif(n0, 0), 6) order_value_before,
      c1 customers_during, c0 customers_before, new_ new_customers, round((t1 - t0) * 100.0 / nullif(t0, 0), 6) revenue_change_pct, round((p1 - p0) * 100.0 / nullif(p0, 0), 6) margin_change_pct, round((n1 - n0) * 100.0 / nullif(n0, 0), 6) orders_change_pct,
      coalesce(t1 > t0 and p1 <= p0, false) more_revenue_less_margin, coalesce(c1 > c0 and p1::double / nullif(n1, 0) <= 0.8 * p0 / nullif(n0, 0), false) more_customers_less_margin from effect""",
    _EFFECT,
)
def campaign_effect(spark: SparkSession, folder: str) -> DataFrame:
    """Campaigns against the thirty days before: orders, revenue, margin, value of an order, customers, new customers, changes, two warning flags."""
    per = star.sales(spark, folder, "order_id", "customer_id", "day", "total4", "profit4").groupBy("order_id", "customer_id", "day").agg(F.sum("total4").alias("t"), F.sum("profit4").alias("p"))
    first = per.groupBy("customer_id").agg(F.min("day").alias("first_day"))
    j = R.within_intervals(per.withColumn("at", _no("day")), _campaigns(spark), [], "at", "lo", "hi", bucket=90).join(first, "customer_id")
    during, early = F.col("day") >= F.col("starts"), F.col("day") < F.col("starts")
    # customers first, so that no distinct count holds a campaign's customers
    c = j.groupBy("campaign_id", "customer_id").agg(
        F.count(F.when(during, 1)).alias("n1"), F.count(F.when(early, 1)).alias("n0"), *[_sum(when, x).alias(f"{x}{k}") for x in "tp" for k, when in ((1, during), (0, early))], F.max((during & (F.col("first_day") == F.col("day"))).cast("int")).alias("new")
    )
    s = c.groupBy("campaign_id").agg(*[F.sum(x).alias(x) for x in ("n1", "n0", "t1", "t0", "p1", "p0", "new")], F.count(F.when(F.col("n1") > 0, 1)).alias("c1"), F.count(F.when(F.col("n0") > 0, 1)).alias("c0"))
    return s.select(
        "campaign_id", F.col("n1").alias("orders_during"), F.col("n0").alias("orders_before"), money(F.col("t1")).alias("revenue_during"), money(F.col("t0")).alias("revenue_before"), money(F.col("p1")).alias("margin_during"),
        money(F.col("p0")).alias("margin_before"), r(ratio(money(F.col("t1")), "n1")).alias("order_value_during"), r(ratio(money(F.col("t0")), "n0")).alias("order_value_before"), F.col("c1").alias("customers_during"), F.col("c0").alias("customers_before"),
        F.col("new").alias("new_customers"), r(pct_change("t1", "t0")).alias("revenue_change_pct"), r(pct_change("p1", "p0")).alias("margin_change_pct"), r(pct_change("n1", "n0")).alias("orders_change_pct"),
        F.coalesce((F.col("t1") > F.col("t0")) & (F.col("p1") <= F.col("p0")), F.lit(False)).alias("more_revenue_less_margin"),
        F.coalesce((F.col("c1") > F.col("c0")) & (ratio("p1", "n1") <= 0.8 * ratio("p0", "n0")), F.lit(False)).alias("more_customers_less_margin"),
    )


_FULL = """
rep as (select item_id, round(count(*) filter (n >= 2)::double / count(*), 9) repeat_rate from (select item_id, customer_id, count(distinct order_id) n from sales group by all) group by 1),
weeks as (select item_id, count(distinct order_id) filter (dayofweek(day) in (0, 6)) weekend, count(distinct date_trunc('month', day)) n_months, min(day) first_day, max(day) last_day, sum(qty) filter (discount2 >= 8) promoted, sum(qty) all_ from sales group by 1),
top3 as (select item_id, sum(units) filter (k <= 3) / sum(units)::double share from (select item_id, units, row_number() over (partition by item_id order by units desc, m) k from (select item_id, date_trunc('month', day)::date m, sum(qty)::bigint units from sales group by all)) group by 1),
vary as (select item_id, count(*) places, round(stddev_pop(t / 10000.0) / avg(t / 10000.0), 9) cv from (select item_id, location, sum(total4)::bigint t from sales group by all) group by 1),
every_ as (
  select *, case when repeat_rate is not null then percent_rank() over (order by repeat_rate asc nulls first) end pr_repeat, case when cv is not null then percent_rank() over (order by cv asc nulls first) end pr_cv
  from scored join final_ using (item_id) left join rep using (item_id) left join weeks using (item_id) left join top3 using (item_id) left join vary using (item_id)
)
"""


def _full(spark: SparkSession, folder: str) -> DataFrame:
    """Items with their scores and what the flags look at. Items are a dimension: ranks over all of them are one window."""
    s = star.sales(spark, folder, "item_id", "order_id", "customer_id", "day", "qty", "discount2")
    scored = sales._scores(sales._per_item(spark, folder).join(sales._waste(spark, folder), "item_id", "left"))
    per_order = s.groupBy("item_id", "order_id", "day").agg(F.sum("qty").alias("q"), F.sum(F.when(F.col("discount2") >= 8, F.col("qty")).otherwise(0)).alias("pq"))
    months = per_order.groupBy("item_id", F.trunc("day", "month").alias("m")).agg(
        F.sum("q").alias("q"), F.sum("pq").alias("pq"), F.count(F.when(F.dayofweek("day").isin(1, 7), 1)).alias("weekend"), F.min("day").alias("a"), F.max("day").alias("b")
    )
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("q"), "m"))
    weeks = months.withColumn("k", k).groupBy("item_id").agg(
        F.sum("weekend").alias("weekend"), F.count("*").alias("months"), F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.sum("pq").alias("promoted"), F.sum("q").alias("all_"), (F.sum(F.when(F.col("k") <= 3, F.col("q"))) / F.sum("q")).alias("share")
    )
    place = star.sales(spark, folder, "item_id", "location", "total4").groupBy("item_id", "location").agg(money(F.sum("total4")).alias("t"))
    vary = place.groupBy("item_id").agg(F.count("*").alias("places"), F.round(F.stddev_pop("t") / F.avg("t"), 9).alias("cv"))
    out = scored.withColumns({"repeat_rate": F.round(ratio("n_repeat", "n_customers"), 9), "profitability": r((F.col("pr_margin") + F.col("pr_pct")) / 2), "demand": r((F.col("pr_units") + F.col("pr_freq")) / 2), "acceptable": F.coalesce(F.col("pr_waste") <= 0.75, F.lit(True))})
    out = out.join(weeks, "item_id", "left").join(vary, "item_id", "left")
    return R.percent_rank(R.percent_rank(out, "repeat_rate", "pr_repeat"), "cv", "pr_cv")


@book.add(
    """select item_id, profitability, demand, round((0.5 + coalesce(pr_repeat, 0.5) + pr_margin) / 3, 6) opportunity, acceptable acceptable_wastage, case when profitability >= 0.6 and demand >= 0.4 and acceptable then 'Profit Driver' when demand >= 0.6 then 'Volume Driver'
      when round((0.5 + coalesce(pr_repeat, 0.5) + pr_margin) / 3, 6) >= 0.6 then 'Hidden Opportunity' else 'Low Performer' end as class from every_""",
    sales._ITEMS + "," + sales._CLASS + "," + _FULL,
)
def menu_four_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Items in four classes by profitability, demand and opportunity; the tables have no rating of an item, whose rank counts as a half."""
    opportunity = r((F.lit(0.5) + F.coalesce("pr_repeat", F.lit(0.5)) + F.col("pr_margin")) / 3)
    out = _full(spark, folder).select("item_id", "profitability", "demand", opportunity.alias("opportunity"), F.col("acceptable").alias("acceptable_wastage"))
    name = F.when((F.col("profitability") >= 0.6) & (F.col("demand") >= 0.4) & F.col("acceptable_wastage"), "Profit Driver").when(F.col("demand") >= 0.6, "Volume Driver").when(F.col("opportunity") >= 0.6, "Hidden Opportunity").otherwise("Low Performer")
    return out.withColumn("class", name)


@book.add(
    """select item_id, coalesce(demand >= 0.75 and p < 0, false) high_selling_loss, coalesce(profitability >= 0.75 and n_orders <= 1, false) profitable_rarely_bought, coalesce(demand >= 0.75 and pr_waste > 0.75, false) popular_high_wastage,
      coalesce(pr_repeat >= 0.75 and profitability < 0.5, false) liked_unprofitable, coalesce(pr_repeat <= 0.25 and demand >= 0.75, false) disliked_popular, coalesce(promoted * 100.0 / all_ >= 50, false) promotion_dependent,
      coalesce(pr_cv >= 0.75 and places >= 2, false) uneven_across_places, coalesce(weekend >= n_orders, false) weekend_only, coalesce(n_months >= 4 and share >= 0.75, false) seasonal, coalesce(datediff('day', first_day, (select max(day) from done)) between 0 and 90 and n_months <= 3, false) new_item from every_""",
    sales._ITEMS + "," + sales._CLASS + "," + _FULL,
)
def menu_edge_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Ten edge cases of items, null as false. Where the rule looks at ratings, the share of customers who buy again stands for them."""
    end = star.orders(spark, folder).agg(F.max("day").alias("end"))
    x = _full(spark, folder).crossJoin(F.broadcast(end))  # one row
    c = F.col
    flags = {
        "high_selling_loss": (c("demand") >= 0.75) & (c("p") < 0), "profitable_rarely_bought": (c("profitability") >= 0.75) & (c("n_orders") <= 1), "popular_high_wastage": (c("demand") >= 0.75) & (c("pr_waste") > 0.75),
        "liked_unprofitable": (c("pr_repeat") >= 0.75) & (c("profitability") < 0.5), "disliked_popular": (c("pr_repeat") <= 0.25) & (c("demand") >= 0.75), "promotion_dependent": ratio("promoted", "all_", 100) >= 50,
        "uneven_across_places": (c("pr_cv") >= 0.75) & (c("places") >= 2), "weekend_only": c("weekend") >= c("n_orders"), "seasonal": (c("months") >= 4) & (c("share") >= 0.75),
        "new_item": F.datediff("end", "first_day").between(0, 90) & (c("months") <= 3),
    }
    return x.select("item_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


_CHURN = """
churn as (
  select customer_id, count(*) n, min(age) recency, count(*) filter (age < 365) n1, count(*) filter (age >= 365 and age < 730) n0, coalesce(sum(t) filter (age < 365), 0)::bigint t1, coalesce(sum(t) filter (age >= 365 and age < 730), 0)::bigint t0,
    count(distinct day) filter (age < 365) v1, count(distinct day) filter (age >= 365 and age < 730) v0, count(distinct channel) filter (age < 365) k1, count(distinct channel) filter (age >= 365 and age < 730) k0
  from (select *, datediff('day', day, d) age from per_order cross join end_) group by 1
), factors as (
  select customer_id, coalesce(recency >= 180 and n >= 2, false) f1, coalesce(n1 < 0.5 * n0, false) f2, coalesce(t1 < 0.5 * t0, false) f3, coalesce(v1 < 0.5 * v0, false) f4, coalesce(k1 < k0, false) f5 from (select c_custkey customer_id from customer) left join churn using (customer_id)
)
"""


@book.add(
    """select customer_id, f1 long_absent, f2 fewer_orders, f3 less_money, f4 fewer_visits, f5 fewer_channels, (f1::int + f2::int + f3::int + f4::int + f5::int)::bigint factors, case when f1::int + f2::int + f3::int + f4::int + f5::int >= 3 then 'High' when f1::int + f2::int + f3::int + f4::int + f5::int = 2 then 'Medium' else 'Low' end risk from factors""",
    sales._CUST + "," + _CHURN,
)
def churn_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Five signs that a customer leaves, the last year against the one before; all customers."""
    orders, per = sales._per_customer(spark, folder)
    o = sales._with_end(orders, per).withColumn("age", F.datediff("end_day", "day"))
    late, early = F.col("age") < 365, F.col("age").between(365, 729)
    s = o.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.min("age").alias("recency"), *[F.count(F.when(w, 1)).alias(f"n{k}") for k, w in ((1, late), (0, early))], *[_sum(w, "t").alias(f"t{k}") for k, w in ((1, late), (0, early))],
        *[F.count_distinct(F.when(w, F.col(c))).alias(f"{x}{k}") for x, c in (("v", "day"), ("k", "channel")) for k, w in ((1, late), (0, early))],
    )
    x = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id")).join(s, "customer_id", "left")
    c = F.col
    flags = {"long_absent": (c("recency") >= 180) & (c("n") >= 2), "fewer_orders": c("n1") < 0.5 * c("n0"), "less_money": c("t1") < 0.5 * c("t0"), "fewer_visits": c("v1") < 0.5 * c("v0"), "fewer_channels": c("k1") < c("k0")}
    x = x.select("customer_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])
    n = sum([F.col(k).cast("bigint") for k in flags], F.lit(0).cast("bigint"))
    return x.withColumn("factors", n).withColumn("risk", F.when(F.col("factors") >= 3, "High").when(F.col("factors") == 2, "Medium").otherwise("Low"))


@book.add(
    """select item_id, supplier_id, w / 100.0 quantity_wasted, q::bigint preparation_quantity, n_days observed_days, latest latest_day, risk, risk >= round(cut_, 6) high_risk, latest + 1 period_start, latest + 30 period_end from (
      select *, quantile_cont(risk, 0.75) over () cut_ from (select item_id, supplier_id, sum(wasted2)::bigint w, sum(qty) q, count(distinct ship_day) n_days, max(ship_day) latest, round(sum(wasted2) / nullif(sum(qty), 0)::double, 6) risk from waste_ group by all))""",
    sales._WASTE,
)
def wastage_risk_places(spark: SparkSession, folder: str) -> DataFrame:
    """Items at places by how much of them is wasted, against the exact third quartile of all, with the period that the figure is for."""
    w = sales._waste_lines(spark, folder).groupBy("item_id", "supplier_id", "ship_day").agg(F.sum("wasted2").alias("w"), F.sum("qty").alias("q"))
    per = w.groupBy("item_id", "supplier_id").agg(F.sum("w").alias("w"), F.sum("q").alias("q"), F.count("ship_day").alias("days"), F.max("ship_day").alias("latest")).withColumn("risk", r(ratio("w", "q")))
    limit = R.exact_percentile(per.select(F.lit(1).alias("one"), F.round(F.col("risk") * 1_000_000).cast("bigint").alias("v")), ["one"], "v", 0.75, bucket=10_000).select((F.col("percentile") / 1e6).alias("cut_"))
    return per.crossJoin(F.broadcast(limit)).select(  # one row
        "item_id", "supplier_id", (F.col("w") / 100.0).cast("double").alias("quantity_wasted"), F.col("q").alias("preparation_quantity"), F.col("days").alias("observed_days"), F.col("latest").alias("latest_day"), "risk",
        (F.col("risk") >= r(F.col("cut_"))).alias("high_risk"), F.date_add("latest", 1).alias("period_start"), F.date_add("latest", 30).alias("period_end"),
    )


@book.add(
    """select promoted, unit, sum(wasted2)::bigint / 100.0 quantity_wasted, sum(qty)::bigint preparation_quantity, count(*) n_lines, round(sum(wasted2) / nullif(sum(qty), 0)::double, 6) wastage_percentage
    from (select unit, qty, wasted2, exists (select 1 from campaigns c where ship_day between c.starts and c.ends) promoted from waste_) group by all""",
    sales._WASTE + "," + temporal._CAMPAIGN_SQL,
)
def wastage_by_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """Wastage on days in and out of campaigns: few intervals, tested per line."""
    inside = F.lit(False)
    for _, a, b in temporal._CAMPAIGNS:
        inside = inside | F.col("ship_day").between(a, b)
    s = sales._waste_lines(spark, folder).groupBy(inside.alias("promoted"), "unit").agg(F.sum("wasted2").alias("w"), F.sum("qty").alias("q"), F.count("*").alias("n_lines"))
    return s.select("promoted", "unit", (F.col("w") / 100.0).cast("double").alias("quantity_wasted"), F.col("q").alias("preparation_quantity"), "n_lines", r(ratio("w", "q")).alias("wastage_percentage"))


@book.add(
    """select location, round(count(*) filter (n >= 2) * 100.0 / count(*), 6) repeat_pct, sum(n)::bigint n_orders, round(sum(p1) / 10000.0 / nullif(sum(n1), 0), 6) margin_per_promoted_order, round(sum(p0) / 10000.0 / nullif(sum(n0), 0), 6) margin_per_other_order from (
      select location, customer_id, count(*) n, count(*) filter (promo) n1, count(*) filter (not promo) n0, coalesce(sum(p) filter (promo), 0)::bigint p1, coalesce(sum(p) filter (not promo), 0)::bigint p0 from (
        select location, any_value(customer_id) customer_id, order_id, max(discount2) >= 8 promo, sum(profit4)::bigint p from sales group by location, order_id) group by all) group by 1"""
)
def location_loyalty(spark: SparkSession, folder: str) -> DataFrame:
    """Per place: customers who come again, and what promoted and other orders leave."""
    o = star.sales(spark, folder, "location", "customer_id", "order_id", "discount2", "profit4").groupBy("location", "customer_id", "order_id").agg((F.max("discount2") >= 8).alias("promo"), F.sum("profit4").alias("p"))
    yes, no = F.col("promo"), ~F.col("promo")
    c = o.groupBy("location", "customer_id").agg(F.count("*").alias("n"), F.count_if(yes).alias("n1"), F.count_if(no).alias("n0"), _sum(yes, "p").alias("p1"), _sum(no, "p").alias("p0"))
    s = c.groupBy("location").agg(F.count_if(F.col("n") >= 2).alias("again"), F.count("*").alias("c"), *[F.sum(x).alias(x) for x in ("n", "n1", "n0", "p1", "p0")])
    return s.select("location", r(ratio("again", "c", 100)).alias("repeat_pct"), F.col("n").alias("n_orders"), r(ratio(money(F.col("p1")), "n1")).alias("margin_per_promoted_order"), r(ratio(money(F.col("p0")), "n0")).alias("margin_per_other_order"))


@book.add(
    """select metric, round(value, 4) as value from (select count(*)::double days_ahead, sum(f) total, max(f) highest_day, avg(f) mean_day, count(distinct location)::double places, count(distinct category)::double categories from ahead)
    unpivot (value for metric in (days_ahead, total, highest_day, mean_day, places, categories))""",
    _AHEAD,
)
def kpi_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Key figures of the forecasts, one row each."""
    one = _ahead(spark, folder).agg(F.count("*").alias("days_ahead"), F.sum("f").alias("total"), F.max("f").alias("highest_day"), F.avg("f").alias("mean_day"), F.count_distinct("location").alias("places"), F.count_distinct("category").alias("categories"))
    return R.unpivot(one, [], ["days_ahead", "total", "highest_day", "mean_day", "places", "categories"]).withColumn("value", r(F.col("value"), 4))


QUERIES, SQL = book.queries, book.sql
