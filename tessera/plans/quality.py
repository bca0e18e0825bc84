"""Checks of data quality, cleaning, filters, and chronologically tested models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arith import r
from tessera.operators import relational as R
from tessera.plans import problems, star, temporal
from tessera.plans.book import Book
from tessera.sources import ingest
from tessera.sources.catalog import CATALOG, table

book = Book(star.SQL)


@book.add(
    """select * from (select 'lines' as what, 'quantity below 1' check_name, count(*) filter (quantity is null or quantity < 1) bad from order_items
    union all select 'lines', 'price below 0 or absent', count(*) filter (unit_price is null or unit_price <= 0) from order_items
    union all select 'lines', 'discount outside 0..100', count(*) filter (discount_percent is null or discount_percent < 0 or discount_percent > 100) from order_items
    union all select 'lines', 'total off by more than 0.02', count(*) filter (abs(line_total - line_subtotal * (1 - discount_percent / 100)) > 0.02) from order_items
    union all select 'orders', 'no day', count(*) filter (order_datetime is null) from restaurant_orders
    union all select 'orders', 'no customer', count(*) filter (customer_id is null or trim(customer_id) = '') from restaurant_orders)"""
)
def quality_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of faulty rows; the checks of a table run in one pass over it."""
    checks = {
        ("order_items", "lines"): {
            "quantity below 1": "quantity is null or quantity < 1",
            "price below 0 or absent": "unit_price is null or unit_price <= 0",
            "discount outside 0..100": "discount_percent is null or discount_percent < 0 or discount_percent > 100",
            "total off by more than 0.02": "abs(line_total - line_subtotal * (1 - discount_percent / 100)) > 0.02",
        },
        ("restaurant_orders", "orders"): {"no day": "order_datetime is null", "no customer": "customer_id is null or trim(customer_id) = ''"},
    }
    out = None
    for (name, what), rules in checks.items():
        one = table(spark, folder, name).agg(*[F.count_if(F.expr(e)).alias(f"c{n}") for n, e in enumerate(rules.values())])
        parts = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(f"c{n}").alias("bad")) for n, k in enumerate(rules)])
        long = one.select(F.lit(what).alias("what"), F.explode(parts).alias("x")).select("what", "x.*")
        out = long if out is None else out.unionByName(long)
    return out


@book.add(
    """select 'orders' child, 'o_custkey' column_name, (select count(*) from orders where o_custkey not in (select c_custkey from customer)) orphans
    union all select 'lineitem', 'l_orderkey', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))
    union all select 'lineitem', 'l_partkey', (select count(*) from lineitem where l_partkey not in (select p_partkey from part))
    union all select 'lineitem', 'l_suppkey', (select count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier))"""
)
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a parent, per reference of the catalog's sales tables."""
    out = None
    for child in ("orders", "lineitem"):
        for column, (parent, key) in CATALOG[child].parents.items():
            n = R.orphans(table(spark, folder, child).select(column), column, table(spark, folder, parent), key).agg(F.count("*").alias("orphans"))
            row = n.select(F.lit(child).alias("child"), F.lit(column).alias("column_name"), "orphans")
            out = row if out is None else out.unionByName(row)
    return out


@book.add(
    """select order_id, line_no, item_id, supplier_id, qty, total4 / 10000.0 total from (select *, row_number() over (partition by order_id, line_no order by item_id, supplier_id, qty, total4, ship_day) k from lines) where k = 1"""
)
def dedupe_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line per order and line number, the least by content: as a min over a struct, which combines on the map side."""
    content = F.struct("item_id", "supplier_id", "qty", "total4", "ship_day")
    d = star.lines(spark, folder).groupBy("order_id", "line_no").agg(F.min(content).alias("v"))
    return d.select("order_id", "line_no", "v.item_id", "v.supplier_id", "v.qty", star.money(F.col("v.total4")).alias("total"))


@book.add("select order_id, line_no, count(*) copies from lines group by all having count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return star.lines(spark, folder).groupBy("order_id", "line_no").agg(F.count("*").alias("copies")).where("copies > 1")


_PROFILED = ("inventory_id", "restaurant_id", "item_id", "unit", "consumed_stock")


@book.add(
    " union all ".join(
        f"select '{c}' column_name, count(*) as rows, count(*) filter ({c} is null or trim({c}) = '') blank, count(distinct {c}) as distinct, min({c}) least, max({c}) greatest from inventory" for c in _PROFILED
    )
)
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return R.profile(table(spark, folder, "inventory"), list(_PROFILED))


@book.add()
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Order-independent fingerprint of the lines; the hash is Spark's own, so there is no SQL."""
    return R.fingerprint(star.lines(spark, folder), ["order_id", "item_id", "qty", "total4"])


@book.add(
    """select coalesce(a.order_id, b.order_id) order_id, case when a.order_id is null then 'only lines' when b.order_id is null then 'only orders' else 'both' end side, coalesce(n, 0) line_count
    from (select distinct order_id from restaurant_orders) a full outer join (select order_id, count(*) n from order_items group by 1) b using (order_id)"""
)
def reconcile_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and lines held against each other by a full outer join of their keys."""
    a = table(spark, folder, "restaurant_orders").select("order_id").distinct().withColumn("a", F.lit(1))
    b = table(spark, folder, "order_items").groupBy("order_id").agg(F.count("*").alias("n"))
    side = F.when(F.col("a").isNull(), "only lines").when(F.col("n").isNull(), "only orders").otherwise("both")
    return a.join(b, "order_id", "full_outer").select("order_id", side.alias("side"), F.coalesce("n", F.lit(0)).alias("line_count"))


@book.add(
    """select order_id, coalesce(try_strptime(nullif(trim(order_date), ''), '%m/%d/%Y'), try_strptime(nullif(trim(order_date), ''), '%Y-%m-%d'), try_strptime(nullif(trim(order_date), ''), '%Y-%m-%d %H:%M:%S'))::date as day,
    trim(order_date) <> '' and coalesce(try_strptime(nullif(trim(order_date), ''), '%m/%d/%Y'), try_strptime(nullif(trim(order_date), ''), '%Y-%m-%d'), try_strptime(nullif(trim(order_date), ''), '%Y-%m-%d %H:%M:%S')) is null and order_date is not null invalid
    from restaurant_orders"""
)
def typed_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Raw text dates as days, with a flag for those that say something else."""
    from pyspark.sql import types as T

    o = table(spark, folder, "restaurant_orders")
    day = ingest.parse("order_date", T.DateType())
    return o.select("order_id", day.alias("day"), F.coalesce((F.trim("order_date") != "") & day.isNull(), F.lit(False)).alias("invalid"))


@book.add("select get_user user_id, k, count(*) n from (select user_id get_user, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by all")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """A field out of JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, folder, "events").groupBy("user_id", k.alias("k")).agg(F.count("*").alias("n"))


@book.add(
    """select order_id, item_id, brand, location, channel, qty, total4 / 10000.0 total from sales where day between date '1997-01-01' and date '1998-12-31' and qty between 5 and 20 and channel in ('1-URGENT', '2-HIGH') and (contains(lower(brand), '2') or contains(lower(location), 'an'))"""
)
def dashboard_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Filters by dates, ranges, lists and free text over several columns; all but the text reach the scans."""
    s = star.sales(spark, folder, "order_id", "item_id", "brand", "location", "channel", "qty", "total4", "day").where(F.col("day").between("1997-01-01", "1998-12-31") & F.col("qty").between(5, 20) & F.col("channel").isin("1-URGENT", "2-HIGH"))
    text = F.lower("brand").contains("2") | F.lower("location").contains("an")
    return s.where(text).select("order_id", "item_id", "brand", "location", "channel", "qty", star.money(F.col("total4")).alias("total"))


@book.add("select order_id, line_no, total4 / 10000.0 total from lines where order_id in (select order_id from done join places using (customer_id) where location = 'FRANCE' or region = 'ASIA')")
def scoped_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that a reader with a scope may see, by their parent order: a semi join."""
    seen = star.orders(spark, folder).join(star.places(spark, folder), "customer_id").where("location = 'FRANCE' or region = 'ASIA'").select("order_id")
    return star.lines(spark, folder).join(seen, "order_id", "left_semi").select("order_id", "line_no", star.money(F.col("total4")).alias("total"))


@book.add(
    """select customer_id, n_all - n_done only_open from (select o_custkey customer_id, count(*) n_all from orders group by 1) join (select customer_id, count(*) n_done from done group by 1) using (customer_id)
    where customer_id not in (select customer_id from done where channel = '1-URGENT')"""
)
def never_urgent(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with completed orders, none of them urgent: an anti join, with a count of their other orders."""
    done, every = star.orders(spark, folder), star.orders(spark, folder, None)
    a, b = every.groupBy("customer_id").agg(F.count("*").alias("n_all")), done.groupBy("customer_id").agg(F.count("*").alias("n_done"))
    urgent = done.where("channel = '1-URGENT'").select("customer_id").distinct()
    return a.join(b, "customer_id").join(urgent, "customer_id", "left_anti").select("customer_id", (F.col("n_all") - F.col("n_done")).alias("only_open"))


@book.add("select item_id from (select item_id from sales where channel = '1-URGENT' intersect select item_id from sales where channel = '2-HIGH') except select item_id from lines where flag = 'R' and qty >= 45")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Items sold in two channels and never returned: intersect and except."""
    s = star.lines(spark, folder).select("order_id", "item_id").join(star.orders(spark, folder).select("order_id", "channel"), "order_id")
    both = s.where("channel = '1-URGENT'").select("item_id").intersect(s.where("channel = '2-HIGH'").select("item_id"))
    return both.exceptAll(star.lines(spark, folder).where("flag = 'R' and qty >= 45").select("item_id").distinct())


@book.add("select item_id, brand, units, round(units * 100.0 / sum(units) over (partition by brand), 6) share, round(cume, 6) cume from (select item_id, brand, units, sum(units) over (partition by brand order by units desc, item_id) * 1.0 / sum(units) over (partition by brand) cume from (select item_id, brand, sum(qty)::bigint units from sales group by all))")
def brand_pareto(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a brand by units, with their share and the running share."""
    from pyspark.sql import Window

    per = star.sales(spark, folder, "item_id", "brand", "qty").groupBy("item_id", "brand").agg(F.sum("qty").alias("units"))
    whole = F.sum("units").over(Window.partitionBy("brand"))
    run = F.sum("units").over(Window.partitionBy("brand").orderBy(F.desc("units"), "item_id").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("item_id", "brand", "units", r(F.col("units") * 100.0 / whole).alias("share"), r(run / whole).alias("cume"))


@book.add("select item, place, sum(qty)::bigint units, sum(qty * price)::bigint revenue2, count(distinct order_no) order_count from (select range % 210 item, range % 27 place, range // 4 order_no, 1 + range % 5 qty, 100 + (range * 7) % 900 price from range(5000000)) group by all")
def scale_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Five million made rows added up by item and place, with distinct orders: no table is read."""
    i = F.col("id")
    rows = spark.range(5_000_000).select((i % 210).alias("item"), (i % 27).alias("place"), F.floor(i / 4).alias("order_no"), (1 + i % 5).alias("qty"), (100 + (i * 7) % 900).alias("price"))
    return rows.groupBy("item", "place").agg(F.sum("qty").alias("units"), F.sum(F.col("qty") * F.col("price")).alias("revenue2"), F.count_distinct("order_no").alias("order_count"))


@book.add()
def demand_model_eval(spark: SparkSession, folder: str) -> DataFrame:
    """A linear model, a tree and a forest on lagged demand, trained on the past, chosen on a later span, tested on the last; against an independent model and lag 7.

    Rows only: no SQL trains models. Columns: model, split, n, mae, rmse, mape, r2, chosen.
    """
    from tessera.ml import demand

    return demand.evaluate(temporal.panel(spark, folder))


@book.add()
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of the chosen and the independent model on the test span, joined by key and compared with a tolerance of a tenth."""
    from tessera.ml import demand

    return demand.compare(temporal.panel(spark, folder))


@book.add()
def wastage_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Next month's high wastage per brand and type, tested on the last months. Rows only: no SQL trains models."""
    from tessera.ml import waste

    li = star.lines(spark, folder).where("flag = 'R'").join(star.items(spark, folder), "item_id")
    return waste.evaluate(li.select(F.concat_ws("/", "brand", "category").alias("item"), F.to_date(F.trunc("ship_day", "month")).alias("month"), F.col("qty").alias("prepared"), (F.col("qty") * F.col("discount2") / 100.0).alias("wasted")))


@book.add()
def stock_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Stock sheets whose numbers don't balance. The units come from the mixture of problem 4, so there is no SQL."""
    from tessera.operators import stock

    return stock.unbalanced(problems._sheets(spark, folder))


@book.add(
    """select order_id, line_no, item_name, brand, location, region, channel, total4 / 10000.0 total from lines left join orders_ using (order_id) left join items using (item_id) left join places using (customer_id)"""
)
def named_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with the names of what it refers to, null where the record isn't there; customers are joined to orders, not to lines."""
    o = star.orders(spark, folder, None).join(star.places(spark, folder), "customer_id", "left")
    s = star.lines(spark, folder).join(o, "order_id", "left").join(star.items(spark, folder), "item_id", "left")
    return s.select("order_id", "line_no", "item_name", "brand", "location", "region", "channel", star.money(F.col("total4")).alias("total"))


@book.add(
    """select metric, round(value, 6) as value from (select count(*)::double items, count(*) filter (p < 0)::double losing, avg(p * 100.0 / nullif(t, 0)) mean_margin, max(units)::double most_units, sum(d) * 100.0 / sum(g) discount_share from (
      select item_id, sum(qty)::bigint units, sum(total4)::bigint t, sum(profit4)::bigint p, sum(gross4)::bigint g, sum(gross4 - total4)::bigint d from sales group by 1)) unpivot (value for metric in (items, losing, mean_margin, most_units, discount_share))"""
)
def kpi_menu(spark: SparkSession, folder: str) -> DataFrame:
    per = star.sales(spark, folder, "item_id", "qty", "total4", "profit4", "gross4").groupBy("item_id").agg(F.sum("qty").alias("units"), F.sum("total4").alias("t"), F.sum("profit4").alias("p"), F.sum("gross4").alias("g"))
    one = per.agg(F.count("*").alias("items"), F.count_if(F.col("p") < 0).alias("losing"), F.avg(F.col("p") * 100.0 / F.nullif("t", F.lit(0))).alias("mean_margin"), F.max("units").alias("most_units"), ((F.sum("g") - F.sum("t")) * 100.0 / F.sum("g")).alias("discount_share"))
    return R.unpivot(one, [], ["items", "losing", "mean_margin", "most_units", "discount_share"]).withColumn("value", r(F.col("value")))


QUERIES, SQL = book.queries, book.sql
