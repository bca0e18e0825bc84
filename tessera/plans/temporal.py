"""Series, forecasts, anomalies, time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.arith import pct_change, r, ratio
from tessera.operators import relational as R
from tessera.operators import trailing
from tessera.plans import star
from tessera.plans.book import Book
from tessera.sources.catalog import table

book = Book(star.SQL)

_PANEL = """
daily as (select brand, region, day, sum(qty)::bigint units from sales group by all),
panel as (
  select s.brand, s.region, s.day, coalesce(d.units, 0)::bigint units from (
    select brand, region, unnest(generate_series(f, (select max(day) from daily), interval 1 day))::date as day from (select brand, region, min(day) f from daily group by all)) s
  left join daily d using (brand, region, day)
)
"""


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily units per brand and region, 0 on days without sales: a gap-free series from its first day on."""
    daily = star.sales(spark, folder, "brand", "region", "day", "qty").groupBy("brand", "region", "day").agg(F.sum("qty").alias("units"))
    return trailing.dense(daily, ["brand", "region"], "day", ["units"])


@book.add("select brand, region, day, units from panel", _PANEL)
def demand_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).select("brand", "region", "day", F.col("units").cast("bigint").alias("units"))


@book.add(
    """select brand, region, day, units, lag(units, 1) over w lag_1, lag(units, 7) over w lag_7, round(avg(units) over (partition by brand, region order by day rows between 7 preceding and 1 preceding), 6) mean_7,
    (dayofweek(day) + 1)::bigint dow, round(sin(2 * pi() * dayofyear(day) / 365.25), 6) day_sin from panel window w as (partition by brand, region order by day)""",
    _PANEL,
)
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    """Lags, trailing mean and calendar features of the gap-free panel; no feature sees its own day."""
    w = Window.partitionBy("brand", "region").orderBy("day")
    p = panel(spark, folder).withColumn("units", F.col("units").cast("bigint"))
    return p.select(
        "brand", "region", "day", "units", F.lag("units", 1).over(w).alias("lag_1"), F.lag("units", 7).over(w).alias("lag_7"), r(F.avg("units").over(w.rowsBetween(-7, -1))).alias("mean_7"), F.dayofweek("day").cast("bigint").alias("dow"),
        r(F.sin(F.lit(2) * F.pi() * F.dayofyear("day") / F.lit(365.25))).alias("day_sin"),
    )


_EVAL = """
scored as (
  select day, units, lag(units, 7) over w naive, avg(units) over (partition by brand, region order by day rows between 7 preceding and 1 preceding) trail
  from panel window w as (partition by brand, region order by day)
), long_ as (
  select 'seasonal_naive' as method, units, naive::double p from scored where day >= date '2001-01-01' and naive is not null and trail is not null
  union all select 'trailing_mean', units, trail from scored where day >= date '2001-01-01' and naive is not null and trail is not null
)
"""


@book.add(
    """select method, count(*) n, round(avg(abs(units - p)), 6) mae, round(sqrt(avg((units - p) ** 2)), 6) rmse, round(avg(case when units <> 0 then abs((units - p) / units) * 100 end), 6) mape,
    round(1 - sum((units - p) ** 2) / (var_pop(units) * count(*)), 6) r2 from long_ group by 1""",
    _PANEL + "," + _EVAL,
)
def forecast_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Two plain forecasts measured on the last months, never on their own past: seasonal naive and trailing mean."""
    w = Window.partitionBy("brand", "region").orderBy("day")
    p = panel(spark, folder).select("day", "units", F.lag("units", 7).over(w).cast("double").alias("seasonal_naive"), F.avg("units").over(w.rowsBetween(-7, -1)).alias("trailing_mean"))
    p = p.where("day >= date'2001-01-01' and seasonal_naive is not null and trailing_mean is not null")
    long = p.unpivot(["day", "units"], ["seasonal_naive", "trailing_mean"], "method", "p")
    out = R.error_metrics(long, "units", "p", ["method"])
    return out.select("method", "n", *[r(F.col(c)).alias(c) for c in ("mae", "rmse", "mape", "r2")])


@book.add(
    """select brand, region, (last_ + h)::date as day, h::bigint horizon_day, round(f, 6) forecast, dayofweek(last_ + h) in (0, 6) is_weekend from (
      select brand, region, max(day) last_, avg(units) filter (day > last_day - 7) f from panel join (select brand, region, max(day) last_day from panel group by all) using (brand, region) group by all)
    cross join (select unnest(generate_series(1, 30))::int h)""",
    _PANEL,
)
def forecast_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty days ahead per series: the mean of its last seven days."""
    p = panel(spark, folder)
    last = p.groupBy("brand", "region").agg(F.max("day").alias("last"))
    week = p.join(last, ["brand", "region"]).where(F.col("day") > F.date_sub("last", 7)).groupBy("brand", "region", "last").agg(F.avg("units").alias("f"))
    out = week.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("day", F.date_add("last", F.col("h")))
    return out.select("brand", "region", "day", F.col("h").cast("bigint").alias("horizon_day"), r(F.col("f")).alias("forecast"), F.dayofweek("day").isin(1, 7).alias("is_weekend"))


@book.add(
    """select day, units, round(mu, 6) baseline, round(sd, 6) spread, case when units > mu + 3 * sd then 'spike' when units < mu - 3 * sd then 'drop' else 'unexpected' end kind from (
      select day, units, avg(units) over w mu, stddev_pop(units) over w sd, count(*) over w n from (
        select s.day, coalesce(u, 0) units from (select unnest(generate_series((select min(day) from orders_), (select max(day) from orders_), interval 1 day))::date as day) s
        left join (select day, sum(qty)::bigint u from lines join orders_ using (order_id) group by 1) using (day))
      window w as (order by day rows between 28 preceding and 1 preceding))
    where n >= 7 and mu > 0 and (abs(units - mu) > 3 * sd or units >= 2 * mu)"""
)
def sales_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Days of the whole chain off their 28-day baseline. The series has one row a day whatever the number of lines."""
    daily = star.lines(spark, folder).join(star.orders(spark, folder, None), "order_id").groupBy("day").agg(F.sum("qty").alias("units")).withColumn("chain", F.lit(1))
    s = trailing.dense(daily, ["chain"], "day", ["units"]).withColumn("no", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("chain").orderBy("no").rangeBetween(-28, -1)
    s = s.select("day", F.col("units").cast("bigint").alias("units"), F.avg("units").over(w).alias("mu"), F.stddev_pop("units").over(w).alias("sd"), F.count("*").over(w).alias("n"))
    off = F.abs(F.col("units") - F.col("mu")) > 3 * F.col("sd")
    kind = F.when(F.col("units") > F.col("mu") + 3 * F.col("sd"), "spike").when(F.col("units") < F.col("mu") - 3 * F.col("sd"), "drop").otherwise("unexpected")
    return s.where((F.col("n") >= 7) & (F.col("mu") > 0) & (off | (F.col("units") >= 2 * F.col("mu")))).select("day", "units", r(F.col("mu")).alias("baseline"), r(F.col("sd")).alias("spread"), kind.alias("kind"))


_RATING = """
ratings as (select event_type item, user_id % 10 place, ts::date as day, (1 + event_id % 5)::bigint rating from events),
per_day as (select item, place, day, count(*) n, sum(rating)::bigint s from ratings group by all)
"""


@book.add(
    """select item, place, day, n, round(s / n::double, 6) mean, round(ps / pn::double, 6) prior_mean, case when s / n::double > ps / pn::double then 'spike' else 'drop' end kind from (
      select *, sum(n) over w pn, sum(s) over w ps from per_day window w as (partition by item, place order by day range between interval 7 days preceding and interval 1 day preceding))
    where n >= 3 and pn >= 3 and abs(round(s / n::double, 6) - round(ps / pn::double, 6)) >= 1""",
    _RATING,
)
def rating_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which an item's mean rating moves by one or more against its last seven calendar days."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("item"), (F.col("user_id") % 10).alias("place"), F.to_date("ts").alias("day"), (1 + F.col("event_id") % 5).alias("rating"))
    d = e.groupBy("item", "place", "day").agg(F.count("*").alias("n"), F.sum("rating").alias("s")).withColumn("no", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("item", "place").orderBy("no").rangeBetween(-7, -1)
    d = d.withColumns({"pn": F.sum("n").over(w), "ps": F.sum("s").over(w)}).withColumns({"mean": r(ratio("s", "n")), "prior_mean": r(ratio("ps", "pn"))})
    hit = d.where((F.col("n") >= 3) & (F.col("pn") >= 3) & (F.abs(F.col("mean") - F.col("prior_mean")) >= 1))
    return hit.select("item", "place", "day", "n", "mean", "prior_mean", F.when(F.col("mean") > F.col("prior_mean"), "spike").otherwise("drop").alias("kind"))


@book.add("select item, count(*) rating_count, round(avg(rating), 6) average_rating, round(stddev_pop(rating), 6) spread, strftime(min(day), '%Y-%m') first_month from ratings group by 1", _RATING)
def rating_by_item(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_type").alias("item"), F.to_date("ts").alias("day"), (1 + F.col("event_id") % 5).alias("rating"))
    return e.groupBy("item").agg(F.count("*").alias("rating_count"), r(F.avg("rating")).alias("average_rating"), r(F.stddev_pop("rating")).alias("spread"), F.date_format(F.min("day"), "yyyy-MM").alias("first_month"))


@book.add(
    """select location, order_id, value2 / 100.0 as value, round(p, 6) threshold from (select location, order_id, value2, quantile_cont(value2 / 100.0, 0.995) over (partition by location) p from done join places using (customer_id)) where value2 / 100.0 > p"""
)
def high_value_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders above the exact 99.5th percentile of their location; thresholds are a row per location, joined back."""
    o = star.orders(spark, folder).join(star.places(spark, folder), "customer_id").select("location", "order_id", "value2")
    limit = R.exact_percentile(o, ["location"], "value2", 0.995, bucket=1_000_000).withColumn("p", F.col("percentile") / 100.0)
    o = o.withColumn("value", (F.col("value2") / 100.0).cast("double"))
    return o.join(limit, "location").where(F.col("value") > F.col("p")).select("location", "order_id", "value", r(F.col("p")).alias("threshold"))


_PRICES = """
price_events as (
  select item_id, since, price4, lag(price4) over (partition by item_id order by since) previous4 from (
    select item_id, date_trunc('quarter', day)::date since, (sum(gross4) // sum(qty))::bigint price4 from lines join orders_ using (order_id) group by all)
)
"""


def _price_events(spark: SparkSession, folder: str) -> DataFrame:
    """The mean unit price of an item per quarter, as if it were a price list, with the price before."""
    p = star.lines(spark, folder).join(star.orders(spark, folder, None), "order_id").groupBy("item_id", F.trunc("day", "quarter").alias("since")).agg(F.expr("sum(gross4) div sum(qty)").alias("price4"))
    return p.withColumn("previous4", F.lag("price4").over(Window.partitionBy("item_id").orderBy("since")))


@book.add("select item_id, since, price4 / 10000.0 price, previous4 / 10000.0 previous_price, round((price4 - previous4) * 100.0 / nullif(previous4, 0), 6) change_pct from price_events", _PRICES)
def price_events(spark: SparkSession, folder: str) -> DataFrame:
    return _price_events(spark, folder).select("item_id", "since", star.money(F.col("price4")).alias("price"), star.money(F.col("previous4")).alias("previous_price"), r(pct_change("price4", "previous4")).alias("change_pct"))


@book.add(
    """select l.item_id, l.order_id, l.line_no, l.qty, p.price4 / 10000.0 price, p.since from (select * from lines where flag = 'R') l asof left join price_events p on l.item_id = p.item_id and l.ship_day >= p.since""",
    _PRICES,
)
def price_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The price in force on the day a returned line was shipped; null before the first price."""
    day_no = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    left = star.lines(spark, folder).where("flag = 'R'").select("item_id", "order_id", "line_no", "qty", day_no("ship_day").alias("at"))
    right = _price_events(spark, folder).select("item_id", "price4", "since", day_no("since").alias("no"))
    out = R.asof_backward(left, right, ["item_id"], "at", "no", ["price4", "since"], bucket=90)
    return out.select("item_id", "order_id", "line_no", "qty", star.money(F.col("price4")).alias("price"), "since")


@book.add(
    """select item_id, since, coalesce(sum(units) filter (day < since), 0)::bigint units_before, coalesce(sum(units) filter (day >= since), 0)::bigint units_after, count(*) filter (day < since) days_before, count(*) filter (day >= since) days_after,
      round((sum(units) filter (day >= since) - sum(units) filter (day < since)) * 100.0 / nullif(sum(units) filter (day < since), 0), 6) demand_change_pct
    from price_events join (select item_id, day, sum(qty)::bigint units from sales group by all) using (item_id) where previous4 > 0 and day >= since - 60 and day < since + 60 group by all""",
    _PRICES,
)
def price_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Units in the 60 days before and after each change of an item's price: daily sums joined with intervals by bucket."""
    day_no = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    daily = star.sales(spark, folder, "item_id", "day", "qty").groupBy("item_id", "day").agg(F.sum("qty").alias("units")).withColumn("at", day_no("day"))
    ev = _price_events(spark, folder).where("previous4 > 0").select("item_id", "since", (day_no("since") - 60).alias("lo"), (day_no("since") + 59).alias("hi"), day_no("since").alias("no"))
    j = R.within_intervals(daily, ev, ["item_id"], "at", "lo", "hi", bucket=120)
    before, after = F.col("at") < F.col("no"), F.col("at") >= F.col("no")
    out = j.groupBy("item_id", "since").agg(
        F.sum(F.when(before, F.col("units"))).alias("b"), F.sum(F.when(after, F.col("units"))).alias("a"), F.count(F.when(before, 1)).alias("days_before"), F.count(F.when(after, 1)).alias("days_after")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select("item_id", "since", zero("b").alias("units_before"), zero("a").alias("units_after"), "days_before", "days_after", r(pct_change("a", "b")).alias("demand_change_pct"))


_CAMPAIGNS = ((1, "1997-02-01", "1997-03-15"), (2, "1998-06-01", "1998-07-31"), (3, "1998-07-01", "1998-08-15"), (4, "2000-11-01", "2000-12-31"))
_CAMPAIGN_SQL = "campaigns as (select * from (values " + ", ".join(f"({i}, date '{a}', date '{b}')" for i, a, b in _CAMPAIGNS) + ") t(campaign_id, starts, ends))"


@book.add(
    """select campaign_id, count(*) filter (day between starts and ends) orders_during, coalesce(sum(value2) filter (day between starts and ends), 0)::bigint / 100.0 revenue_during, count(*) filter (day < starts) orders_before, count(*) filter (day > ends) orders_after,
    count(distinct customer_id) filter (day between starts and ends) customers_during from done join campaigns on day between starts - 30 and ends + 30 group by 1""",
    _CAMPAIGN_SQL,
)
def campaign_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in, before and after each campaign: orders joined with few intervals by bucket of days, then conditional sums."""
    day_no = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    c = spark.createDataFrame([(i, a, b) for i, a, b in _CAMPAIGNS], "campaign_id int, starts string, ends string").withColumns({"starts": F.to_date("starts"), "ends": F.to_date("ends")})
    c = c.withColumns({"lo": day_no("starts") - 30, "hi": day_no("ends") + 30})
    j = R.within_intervals(star.orders(spark, folder).withColumn("at", day_no("day")), c, [], "at", "lo", "hi", bucket=90)
    during = F.col("day").between(F.col("starts"), F.col("ends"))
    return j.groupBy("campaign_id").agg(
        F.count(F.when(during, 1)).alias("orders_during"), (F.sum(F.when(during, F.col("value2")).otherwise(0)) / 100.0).cast("double").alias("revenue_during"), F.count(F.when(F.col("day") < F.col("starts"), 1)).alias("orders_before"),
        F.count(F.when(F.col("day") > F.col("ends"), 1)).alias("orders_after"), F.count_distinct(F.when(during, F.col("customer_id"))).alias("customers_during"),
    )


@book.add("select campaign_id, starts, ends, latest_end from (select *, max(ends) over (order by starts, ends rows between unbounded preceding and 1 preceding) latest_end from campaigns) where starts <= latest_end", _CAMPAIGN_SQL)
def interval_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Campaigns that begin before an earlier one has ended."""
    c = spark.createDataFrame([(i, a, b) for i, a, b in _CAMPAIGNS], "campaign_id int, starts string, ends string").withColumns({"starts": F.to_date("starts"), "ends": F.to_date("ends"), "one": F.lit(1)})
    return R.overlaps(c, ["one"], "starts", "ends").drop("one")


@book.add(
    """select cohort, "offset"::bigint as "offset", active, round(active * 100.0 / first_value(active) over (partition by cohort order by "offset"), 6) retention_pct from (
      select (c // 12)::varchar || '-' || lpad((c % 12 + 1)::varchar, 2, '0') cohort, m - c as "offset", count(*) active from (
        select customer_id, m, min(m) over (partition by customer_id) c from (select distinct customer_id, year(day) * 12 + month(day) - 1 m from done)) group by all)"""
)
def cohort_retention(spark: SparkSession, folder: str) -> DataFrame:
    return R.cohorts(star.orders(spark, folder), "customer_id", "day").select("cohort", F.col("offset").cast("bigint").alias("offset"), "active", r(F.col("retention_pct")).alias("retention_pct"))


@book.add(
    """select d.dow, h.h as hour, coalesce(n, 0) event_count from (select unnest(generate_series(1, 7))::bigint dow) d cross join (select unnest(generate_series(0, 23))::bigint h) h
    left join (select (dayofweek(ts) + 1)::bigint dow, hour(ts)::bigint h, count(*) n from events group by all) using (dow, h)"""
)
def activity_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Events per weekday and hour, every combination present."""
    per = table(spark, folder, "events").groupBy(F.dayofweek("ts").cast("bigint").alias("dow"), F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    full = R.grid(spark.range(1, 8).toDF("dow"), spark.range(24).toDF("hour"))
    return full.join(per, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("event_count"))


@book.add(
    """select bin, count(*) customers from (select least(10, 1 + (recency * 10 // greatest(1, hi + 1))) ::bigint bin from (select datediff('day', max(day), (select max(day) from done)) recency from done group by customer_id)
    cross join (select max(x) hi from (select datediff('day', max(day), (select max(day) from done)) x from done group by customer_id))) group by 1"""
)
def recency_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in ten equal bins of days since their last order."""
    o = star.orders(spark, folder)
    last = o.groupBy("customer_id").agg(F.max("day").alias("last"))
    end = last.agg(F.max("last").alias("end"))
    rec = last.crossJoin(F.broadcast(end)).select(F.datediff("end", "last").cast("bigint").alias("recency"))
    hi = rec.agg(F.max("recency").alias("hi"))
    return rec.crossJoin(F.broadcast(hi)).groupBy(F.least(F.lit(10), 1 + F.expr("recency * 10 div greatest(1, hi + 1)")).cast("bigint").alias("bin")).agg(F.count("*").alias("customers"))


@book.add(
    """select d.day, c.channel, coalesce(n, 0) order_count from (select unnest(generate_series((select min(day) from done), (select max(day) from done), interval 1 day))::date as day) d cross join (select distinct channel from done) c
    left join (select day, channel, count(*) n from done group by all) using (day, channel)"""
)
def channel_daily_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per day and channel, every day present."""
    per = star.orders(spark, folder).groupBy("day", "channel").agg(F.count("*").alias("n"))
    ends = per.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return R.grid(days, per.select("channel").distinct()).join(per, ["day", "channel"], "left").select("day", "channel", F.coalesce("n", F.lit(0)).alias("order_count"))


@book.add(
    """select user_id, session, min(ts) as started, count(*) events from (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint session from (
      select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours then 0 else 1 end fresh from events)) group by all"""
)
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user in sessions that end after six idle hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").select("user_id", "ts", "event_id")
    fresh = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("interval 6 hours"), 0).otherwise(1)
    s = e.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.count("*").alias("events"))


QUERIES, SQL = book.queries, book.sql
