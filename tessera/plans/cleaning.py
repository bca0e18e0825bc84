"""Cleaning of the restaurant tables, their integration, and further checks on events and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arith import pct_change, r, ratio
from tessera.functions.calendar import real_day
from tessera.functions.keys import key_or_null, norm
from tessera.operators import cleaning as C
from tessera.operators import relational as R
from tessera.plans import problems, star, temporal
from tessera.plans.book import Book
from tessera.sources.catalog import table

book = Book(star.SQL)

_RAW = f"""
raw_orders as (
  select {problems._norm("order_id")} order_id, min({problems._key("customer_id")}) customer_id, min({problems._key("restaurant_id")}) restaurant_id, min({problems._DAY}) as day, min(status) status, min(delivery_charge) delivery
  from restaurant_orders group by 1
), good_orders as (
  select * from raw_orders where day is not null and customer_id in (select {problems._key("customer_id")} k from customers where k is not null) and restaurant_id in (select {problems._key("restaurant_id")} k from restaurants where k is not null)
), raw_lines as (
  select {problems._norm("order_item_id")} line, min({problems._norm("order_id")}) order_id, min({problems._key("item_id")}) item_id, min(quantity) quantity, min(unit_price) unit_price, min(discount_percent) discount from order_items group by 1
), good_lines as (
  select min(line) line, order_id, item_id, quantity, unit_price, min(greatest(0, least(100, coalesce(discount, 0)))) discount from raw_lines
  where quantity > 0 and unit_price > 0 and unit_price <= 10000 and item_id in (select {problems._key("item_id")} k from menu_items where k is not null) and order_id in (select order_id from good_orders)
  group by order_id, item_id, quantity, unit_price
)
"""


def _orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(distinct orders with keys and day, those that keep all rules)."""
    o = table(spark, folder, "restaurant_orders").select(
        norm("order_id").alias("order_id"), key_or_null("customer_id").alias("customer_id"), key_or_null("restaurant_id").alias("restaurant_id"), F.coalesce(real_day("order_date"), F.col("order_datetime").cast("date")).alias("day"), "status",
        F.col("delivery_charge").alias("delivery"),
    )
    o = o.groupBy("order_id").agg(*[F.min(c).alias(c) for c in ("customer_id", "restaurant_id", "day", "status", "delivery")])
    flagged = C.with_parent(o, "customer_id", table(spark, folder, "customers"), "customer_id", "has_customer")
    flagged = C.with_parent(flagged, "restaurant_id", table(spark, folder, "restaurants"), "restaurant_id", "has_restaurant")
    reason = C.first_reason([("no day", F.col("day").isNotNull()), ("no such customer", F.col("has_customer")), ("no such restaurant", F.col("has_restaurant"))])
    return flagged, flagged.withColumn("reason", reason)


def good_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder)[1].where("reason is null")


def good_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines once per key and once per content, of sound quantity and price, of menu items and good orders."""
    li = table(spark, folder, "order_items").select(norm("order_item_id").alias("line"), norm("order_id").alias("order_id"), key_or_null("item_id").alias("item_id"), "quantity", "unit_price", F.col("discount_percent").alias("discount"))
    li = li.groupBy("line").agg(*[F.min(c).alias(c) for c in ("order_id", "item_id", "quantity", "unit_price", "discount")])
    li = li.where("quantity > 0 and unit_price > 0 and unit_price <= 10000")
    li = C.with_parent(li, "item_id", table(spark, folder, "menu_items"), "item_id", "hit").where("hit").drop("hit")
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("discount", F.lit(0))))
    li = li.groupBy("order_id", "item_id", "quantity", "unit_price").agg(F.min("line").alias("line"), F.min(clamped).alias("discount"))
    return li.join(good_orders(spark, folder).select("order_id"), "order_id", "left_semi")


@book.add("select order_id, customer_id, restaurant_id, day, status from good_orders", _RAW)
def clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    return good_orders(spark, folder).select("order_id", "customer_id", "restaurant_id", "day", "status")


@book.add(
    """select order_id, case when day is null then 'no day' when customer_id is null or customer_id not in (select order_customer from (select """
    + problems._key("customer_id")
    + """ order_customer from customers) where order_customer is not null) then 'no such customer' else 'no such restaurant' end reason from raw_orders where order_id not in (select order_id from good_orders)""",
    _RAW,
)
def quarantined_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders put aside, with the first rule that each breaks."""
    return _orders(spark, folder)[1].where("reason is not null").select("order_id", "reason")


@book.add(
    "select line, order_id, item_id, quantity, round(unit_price * quantity, 2)::double line_subtotal, round(round(unit_price * quantity, 2) * (100 - discount) / 100, 4)::double line_total from good_lines", _RAW
)
def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their totals made anew from price, quantity and the discount held to 0..100."""
    sub = F.round(F.col("unit_price") * F.col("quantity"), 2)
    return good_lines(spark, folder).select("line", "order_id", "item_id", "quantity", sub.cast("double").alias("line_subtotal"), F.round(sub * (100 - F.col("discount")) / 100, 4).cast("double").alias("line_total"))


@book.add(
    """select order_id, n item_count, t::double total, round(t + coalesce(delivery, 0), 4)::double with_delivery from good_orders join (
      select order_id, count(*) n, sum(round(round(unit_price * quantity, 2) * (100 - discount) / 100, 4)) t from good_lines group by 1) using (order_id)""",
    _RAW,
)
def clean_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals derived from the good lines."""
    sub = F.round(F.col("unit_price") * F.col("quantity"), 2)
    per = good_lines(spark, folder).groupBy("order_id").agg(F.count("*").alias("item_count"), F.sum(F.round(sub * (100 - F.col("discount")) / 100, 4)).alias("t"))
    o = good_orders(spark, folder).select("order_id", "delivery")
    return o.join(per, "order_id").select("order_id", "item_count", F.col("t").cast("double").alias("total"), F.round(F.col("t") + F.coalesce("delivery", F.lit(0)), 4).cast("double").alias("with_delivery"))


@book.add(
    """select 'orders' as what, (select count(*) from restaurant_orders) rows_in, (select count(*) from raw_orders) distinct_keys, (select count(*) from good_orders) rows_out
    union all select 'lines', (select count(*) from order_items), (select count(*) from raw_lines), (select count(*) from good_lines)""",
    _RAW,
)
def clean_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in, distinct keys and rows out of the cleaning."""
    out = None
    for what, name, key, good in (("orders", "restaurant_orders", "order_id", good_orders), ("lines", "order_items", "order_item_id", good_lines)):
        a = table(spark, folder, name).agg(F.count("*").alias("rows_in"), F.count_distinct(norm(key)).alias("distinct_keys"))
        row = a.crossJoin(good(spark, folder).agg(F.count("*").alias("rows_out"))).select(F.lit(what).alias("what"), "rows_in", "distinct_keys", "rows_out")
        out = row if out is None else out.unionByName(row)
    return out


_RELATED = ("menu_items", "customers", "restaurant_orders", "order_items", "inventory")


def _relation_sql() -> str:
    from tessera.sources.catalog import CATALOG

    return " union all ".join(
        f"select '{n}' child, '{c}' column_name, '{p}' parent, count(*) as rows, count({problems._key(c)}) referring, count(*) filter ({problems._key(c)} in (select {problems._key(k)} from {p})) matched from {n}"
        for n in _RELATED
        for c, (p, k) in CATALOG[n].parents.items()
    )


@book.add(_relation_sql())
def integration(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference of the restaurant tables, with how many rows refer and match; generated from the catalog."""
    names = {*_RELATED, "menu_categories", "restaurants"}
    return C.relationships({n: table(spark, folder, n) for n in names}, list(_RELATED))


@book.add(
    f"""select i.k inventory_id, coalesce(s.sold, 0)::bigint sold from (select {problems._norm("inventory_id")} k, min({problems._key("restaurant_id")}) r, min({problems._key("item_id")}) item, min(month_start) m from inventory group by 1) i
    left join (select restaurant_id, item_id, date_trunc('month', day)::date m, sum(quantity) sold from good_lines join good_orders using (order_id) group by all) s on s.restaurant_id = i.r and s.item_id = i.item and s.m = i.m""",
    _RAW,
)
def stock_context(spark: SparkSession, folder: str) -> DataFrame:
    """What a branch sold of an item in the month of each stock sheet: an equi join on the truncated day."""
    inv = table(spark, folder, "inventory").select(norm("inventory_id").alias("inventory_id"), key_or_null("restaurant_id").alias("restaurant_id"), key_or_null("item_id").alias("item_id"), F.col("month_start").alias("m"))
    inv = inv.groupBy("inventory_id").agg(*[F.min(c).alias(c) for c in ("restaurant_id", "item_id", "m")])
    sold = good_lines(spark, folder).join(good_orders(spark, folder).select("order_id", "restaurant_id", "day"), "order_id").groupBy("restaurant_id", "item_id", F.to_date(F.trunc("day", "month")).alias("m")).agg(F.sum("quantity").alias("sold"))
    return inv.join(sold, ["restaurant_id", "item_id", "m"], "left").select("inventory_id", F.coalesce("sold", F.lit(0)).cast("bigint").alias("sold"))


@book.add(
    f"select k customer_id, city, age, n deliveries from (select {problems._norm('customer_id')} k, arg_max(city, loaded_at) city, arg_max(age, loaded_at) age, count(*) n from customers group by 1)"
)
def latest_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The latest delivery of each customer: as max_by, which combines on the map side."""
    return table(spark, folder, "customers").groupBy(norm("customer_id").alias("customer_id")).agg(F.max_by("city", "loaded_at").alias("city"), F.max_by("age", "loaded_at").alias("age"), F.count("*").alias("deliveries"))


@book.add(
    f"""select * from (select 'restaurant_orders' table_name, min({problems._DAY}) first_day, max({problems._DAY}) last_day from restaurant_orders union all select 'inventory', min(month_start), max(month_start) from inventory union all select 'documents', min(decided_on), max(decided_on) from documents)"""
)
def date_bounds(spark: SparkSession, folder: str) -> DataFrame:
    days = {"restaurant_orders": F.coalesce(real_day("order_date"), F.col("order_datetime").cast("date")), "inventory": F.col("month_start"), "documents": F.col("decided_on")}
    rows = [table(spark, folder, n).agg(F.min(d).alias("first_day"), F.max(d).alias("last_day")).select(F.lit(n).alias("table_name"), "first_day", "last_day") for n, d in days.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_RATING = temporal._RATING


#: Ratings of a day at least, and times the mean before it, that make a burst; ratings of a week at least, and share of one value, that make it
#: uniform. The values give rows on these tables; sparse real ratings want 10, 5, 10 and 0.9.
BURST_ROWS, BURST_TIMES, SAME_ROWS, SAME_SHARE = 8, 2, 5, 0.4


def _ratings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("user_id", F.col("event_type").alias("item"), (F.col("user_id") % 10).alias("place"), F.to_date("ts").alias("day"), (1 + F.col("event_id") % 5).alias("rating"))


@book.add(
    f"""select item, place, day, n, round(mean, 6) prior_mean from (select *, avg(n) over (partition by item, place order by day range between interval 30 days preceding and interval 1 day preceding) mean from per_day) where n >= {BURST_ROWS} and n >= {BURST_TIMES} * mean""",
    _RATING,
)
def rating_bursts(spark: SparkSession, folder: str, least: int = BURST_ROWS, times: float = BURST_TIMES) -> DataFrame:
    """Days with `times` the mean number of ratings of the last 30 calendar days."""
    from pyspark.sql import Window

    d = _ratings(spark, folder).groupBy("item", "place", "day").agg(F.count("*").alias("n")).withColumn("no", F.datediff("day", F.lit("1970-01-01").cast("date")))
    d = d.withColumn("mean", F.avg("n").over(Window.partitionBy("item", "place").orderBy("no").rangeBetween(-30, -1)))
    return d.where((F.col("n") >= least) & (F.col("n") >= times * F.col("mean"))).select("item", "place", "day", "n", r(F.col("mean")).alias("prior_mean"))


@book.add(
    f"""select item, place, wk as "week", n, top from (select item, place, wk, sum(c)::bigint n, max(c) top from (select item, place, date_trunc('week', day)::date as wk, rating, count(*) c from ratings group by all) group by all) where n >= {SAME_ROWS} and top >= {SAME_SHARE} * n""",
    _RATING,
)
def rating_identical(spark: SparkSession, folder: str, least: int = SAME_ROWS, share: float = SAME_SHARE) -> DataFrame:
    """Weeks in which one value makes up a share of an item's ratings or more."""
    per = _ratings(spark, folder).groupBy("item", "place", F.to_date(F.date_trunc("week", "day")).alias("week"), "rating").agg(F.count("*").alias("c"))
    per = per.groupBy("item", "place", "week").agg(F.sum("c").alias("n"), F.max("c").alias("top"))
    return per.where((F.col("n") >= least) & (F.col("top") >= share * F.col("n")))


@book.add("select user_id, item, place, day from (select user_id, event_type item, user_id % 10 place, ts::date as day from events) r where not exists (select 1 from events b where b.event_type = 'purchase' and b.user_id = r.user_id and b.ts::date = r.day)")
def rating_inconsistent(spark: SparkSession, folder: str) -> DataFrame:
    """Events of users without a purchase on that day: an anti join on a tuple."""
    e = _ratings(spark, folder)
    return e.join(e.where("item = 'purchase'").select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").select("user_id", "item", "place", "day")


@book.add("select order_item_id, discount_percent::double discount_percent, case when discount_percent > 50 then 'above half' else 'above gross' end kind from order_items where discount_percent > 50 or line_subtotal - line_total > line_subtotal")
def discount_outliers(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "order_items").where("discount_percent > 50 or line_subtotal - line_total > line_subtotal")
    return o.select("order_item_id", F.col("discount_percent").cast("double").alias("discount_percent"), F.when(F.col("discount_percent") > 50, "above half").otherwise("above gross").alias("kind"))


@book.add("select region, day, horizon_day, round(sum(forecast), 4) forecast from forecast group by all",
    temporal._PANEL + """, forecast as (select brand, region, (last_ + h)::date as day, h::bigint horizon_day, round(f, 6) forecast from (
      select brand, region, max(day) last_, avg(units) filter (day > last_day - 7) f from panel join (select brand, region, max(day) last_day from panel group by all) using (brand, region) group by all) cross join (select unnest(generate_series(1, 30))::int h))""")  # fmt: skip
def forecast_region(spark: SparkSession, folder: str) -> DataFrame:
    """The daily forecasts added up by region."""
    return temporal.forecast_daily(spark, folder).groupBy("region", "day", "horizon_day").agg(r(F.sum("forecast"), 4).alias("forecast"))


@book.add(
    """select campaign_id, count(*) participants, count(*) filter (again > 0) returned, count(*) filter (first_day = first_in) new_customers from (
      select c.campaign_id, d.customer_id, min(d.day) first_in, any_value(f.first_day) first_day, (select count(*) from done x where x.customer_id = d.customer_id and x.day > any_value(c.ends) and x.day <= any_value(c.ends) + 180) again
      from done d join campaigns c on d.day between c.starts and c.ends join (select customer_id, min(day) first_day from done group by 1) f on f.customer_id = d.customer_id group by c.campaign_id, d.customer_id) group by 1""",
    temporal._CAMPAIGN_SQL,
)
def campaign_repeat(spark: SparkSession, folder: str) -> DataFrame:
    """Participants of each campaign, how many came back within 180 days, and how many were new: equi joins on the customer with time tests on top."""
    o = star.orders(spark, folder).select("customer_id", "day")
    c = spark.createDataFrame([(i, a, b) for i, a, b in temporal._CAMPAIGNS], "campaign_id int, starts string, ends string").withColumns({"starts": F.to_date("starts"), "ends": F.to_date("ends")})
    no = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date"))
    inside = R.within_intervals(o.withColumn("at", no("day")), c.withColumns({"lo": no("starts"), "hi": no("ends")}), [], "at", "lo", "hi", 90)
    part = inside.groupBy("campaign_id", "customer_id", "ends").agg(F.min("day").alias("first_in"))
    later = part.select("campaign_id", "customer_id", "ends").join(o, "customer_id").where("day > ends and day <= date_add(ends, 180)").select("campaign_id", "customer_id").distinct().withColumn("again", F.lit(1))
    first = o.groupBy("customer_id").agg(F.min("day").alias("first_day"))
    out = part.join(later, ["campaign_id", "customer_id"], "left").join(first, "customer_id")
    return out.groupBy("campaign_id").agg(F.count("*").alias("participants"), F.count("again").alias("returned"), F.count_if(F.col("first_day") == F.col("first_in")).alias("new_customers"))


@book.add(
    """select campaign_id, count(*) pairs, count(*) filter (outside = 0) only_inside from (
      select c.campaign_id, s.customer_id, s.brand, (select count(*) from sales x where x.customer_id = s.customer_id and x.brand = s.brand and not (x.day between any_value(c.starts) and any_value(c.ends))) outside
      from sales s join campaigns c on s.day between c.starts and c.ends group by c.campaign_id, s.customer_id, s.brand) group by 1""",
    temporal._CAMPAIGN_SQL,
)
def campaign_only_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and brands bought in a campaign, and those bought in no other time: counts per pair, then their difference."""
    s = star.sales(spark, folder, "customer_id", "brand", "day")
    no = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date"))
    c = spark.createDataFrame([(i, a, b) for i, a, b in temporal._CAMPAIGNS], "campaign_id int, starts string, ends string").withColumns({"lo": no(F.to_date("starts")), "hi": no(F.to_date("ends"))})
    inside = R.within_intervals(s.withColumn("at", no("day")), c.select("campaign_id", "lo", "hi"), [], "at", "lo", "hi", 90).groupBy("campaign_id", "customer_id", "brand").agg(F.count("*").alias("n_in"))
    every = s.groupBy("customer_id", "brand").agg(F.count("*").alias("n_all"))
    return inside.join(every, ["customer_id", "brand"]).groupBy("campaign_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("n_all") == F.col("n_in")).alias("only_inside"))


@book.add(
    """select item_id, coalesce(recent, 0)::bigint recent_units, coalesce(prior, 0)::bigint prior_units, round((recent - prior) * 100.0 / nullif(prior, 0), 6) trend_pct from (
      select item_id, sum(qty) filter (age < 365) recent, sum(qty) filter (age >= 365 and age < 730) prior from (select item_id, qty, datediff('day', day, (select max(day) from done)) age from sales) group by 1)"""
)
def item_trend(spark: SparkSession, folder: str) -> DataFrame:
    """An item's units in the last year of the data against the year before."""
    s = star.sales(spark, folder, "item_id", "qty", "day")
    end = star.orders(spark, folder).agg(F.max("day").alias("end"))
    s = s.crossJoin(F.broadcast(end)).withColumn("age", F.datediff("end", "day"))
    a = s.groupBy("item_id").agg(F.sum(F.when(F.col("age") < 365, F.col("qty"))).alias("a"), F.sum(F.when((F.col("age") >= 365) & (F.col("age") < 730), F.col("qty"))).alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return a.select("item_id", zero("a").alias("recent_units"), zero("b").alias("prior_units"), r(pct_change("a", "b")).alias("trend_pct"))


@book.add(
    """select n::bigint n, round(chi2, 4) chi2, round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 6) v from (select sum(o * o * n / (na * nb)) - any_value(n) chi2, any_value(n) n, any_value(ka) ka, any_value(kb) kb from (
      select o, sum(o) over (partition by channel) na, sum(o) over (partition by location) nb, sum(o) over () n, (select count(distinct channel) from done) ka, (select count(distinct location) from done join places using (customer_id)) kb
      from (select channel, location, count(*)::double o from done join places using (customer_id) group by all)))"""
)
def branch_variation(spark: SparkSession, folder: str) -> DataFrame:
    """How far channel and location depend on each other."""
    o = star.orders(spark, folder).join(star.places(spark, folder), "customer_id")
    return C.cramers_v(o, "channel", "location").select("n", r(F.col("chi2"), 4).alias("chi2"), r(F.col("v")).alias("v"))


@book.add(
    """select 'both' part, count(*) customers from (select customer_id from done where day < date '1998-01-01' intersect select customer_id from done where day >= date '1998-01-01')
    union all select 'only early', count(*) from (select customer_id from done where day < date '1998-01-01' except select customer_id from done where day >= date '1998-01-01')
    union all select 'only late', count(*) from (select customer_id from done where day >= date '1998-01-01' except select customer_id from done where day < date '1998-01-01')"""
)
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Customers on either side of a date: one pass instead of three set operations."""
    per = star.orders(spark, folder).groupBy("customer_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    cut = F.lit("1998-01-01").cast("date")
    part = F.when((F.col("a") < cut) & (F.col("b") >= cut), "both").when(F.col("b") < cut, "only early").otherwise("only late")
    return per.groupBy(part.alias("part")).agg(F.count("*").alias("customers"))


@book.add(
    """select flag reason, unit, sum(qty * discount2)::bigint / 100.0 quantity_wasted, count(*) record_count from lines group by all"""
)
def wastage_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    out = star.lines(spark, folder).groupBy(F.col("flag").alias("reason"), "unit").agg(F.sum(F.col("qty") * F.col("discount2")).alias("w"), F.count("*").alias("record_count"))
    return out.select("reason", "unit", (F.col("w") / 100.0).cast("double").alias("quantity_wasted"), "record_count")


@book.add(
    """select bucket, unit, sum(w)::bigint / 100.0 quantity_wasted, sum(q)::bigint preparation_quantity, count(*) items from (
      select item_id, unit, w, q, case when units is null then 'none' when units <= 100 then 'low' when units <= 250 then 'medium' else 'high' end bucket
      from (select item_id, unit, sum(qty * discount2) w, sum(qty) q from lines where flag = 'R' group by all) left join (select item_id, sum(qty) units from sales group by 1) using (item_id)) group by all"""
)
def wastage_by_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Wastage of items by how much of them is sold."""
    w = star.lines(spark, folder).where("flag = 'R'").groupBy("item_id", "unit").agg(F.sum(F.col("qty") * F.col("discount2")).alias("w"), F.sum("qty").alias("q"))
    u = star.sales(spark, folder, "item_id", "qty").groupBy("item_id").agg(F.sum("qty").alias("units"))
    bucket = F.when(F.col("units").isNull(), "none").when(F.col("units") <= 100, "low").when(F.col("units") <= 250, "medium").otherwise("high")
    out = w.join(u, "item_id", "left").groupBy(bucket.alias("bucket"), "unit").agg(F.sum("w").alias("w"), F.sum("q").alias("preparation_quantity"), F.count("*").alias("items"))
    return out.select("bucket", "unit", (F.col("w") / 100.0).cast("double").alias("quantity_wasted"), "preparation_quantity", "items")


@book.add(
    """select metric, round(value, 6) as value from (select count(*)::double customers, count(*) filter (n >= 2)::double repeating, avg(n) mean_orders, max(n)::double most_orders, sum(t) / 10000.0 / count(*) mean_money from (
      select customer_id, count(distinct order_id) n, sum(total4)::bigint t from sales group by 1)) unpivot (value for metric in (customers, repeating, mean_orders, most_orders, mean_money))"""
)
def kpi_customer(spark: SparkSession, folder: str) -> DataFrame:
    per = star.sales(spark, folder, "customer_id", "order_id", "total4").groupBy("customer_id", "order_id").agg(F.sum("total4").alias("t")).groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    one = per.agg(F.count("*").alias("customers"), F.count_if(F.col("n") >= 2).alias("repeating"), F.avg("n").alias("mean_orders"), F.max("n").alias("most_orders"), (F.sum("t") / 10000.0 / F.count("*")).alias("mean_money"))
    return R.unpivot(one, [], ["customers", "repeating", "mean_orders", "most_orders", "mean_money"]).withColumn("value", r(F.col("value")))


@book.add(
    """select unit, round(sum(wasted2) / 100.0, 2) quantity_wasted, round(sum(wasted2) / sum(qty)::double, 6) wastage_percentage, count(distinct item_id) items, count(distinct supplier_id) places from (select *, qty * discount2 wasted2 from lines where flag = 'R') group by 1"""
)
def kpi_wastage(spark: SparkSession, folder: str) -> DataFrame:
    w = star.lines(spark, folder).where("flag = 'R'").withColumn("wasted2", F.col("qty") * F.col("discount2"))
    one = w.groupBy("unit").agg(F.sum("wasted2").alias("w"), F.sum("qty").alias("q"), F.count_distinct("item_id").alias("items"), F.count_distinct("supplier_id").alias("places"))
    return one.select("unit", r(F.col("w") / 100.0, 2).alias("quantity_wasted"), r(ratio("w", "q")).alias("wastage_percentage"), "items", "places")


QUERIES, SQL = book.queries, book.sql
