"""The star view of the sales tables, in Spark and as the same SQL.

Money is kept in integers of a ten-thousandth, so that sums are exact in any order: gross4, total4, cost4, profit4. Orders of
status F are the completed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import table

STATUS = "F"


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def orders(spark: SparkSession, folder: str, status: str | None = STATUS) -> DataFrame:
    """order_id, customer_id, channel, day, value2 (cents) of the orders of a status, or of all."""
    o = table(spark, folder, "orders")
    if status is not None:
        o = o.where(F.col("o_orderstatus") == status)
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("channel"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("value2"))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """customer_id, location (nation), region. Nations and regions are fixed tables."""
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("customer_id", F.col("n_name").alias("location"), F.col("r_name").alias("region"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """order_id, item_id, supplier_id, qty, gross4, discount2, total4, returned, ship_day of every line."""
    li = table(spark, folder, "lineitem")
    d = F.round(F.col("l_discount") * 100).cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").cast("bigint").alias("qty"),
        (cents("l_extendedprice") * 100).alias("gross4"), d.alias("discount2"), (cents("l_extendedprice") * (100 - d)).alias("total4"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("unit"), F.to_date("l_shipdate").alias("ship_day"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), cents("p_retailprice").alias("cost2"))


#: Columns of `sales` that a dimension has, or that need one.
_OF_ITEMS, _OF_PLACES = {"item_name", "brand", "category", "cost2", "cost4", "profit4"}, {"location", "region"}


def sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Completed lines with the columns asked for; profit4 = total4 - cost4, of the line's order, item and place.

    Only the dimensions that the columns need are joined, since Catalyst keeps an inner join whose columns nobody reads. Customers
    and nations are joined to orders, which are fewer than lines, so that lines never move by their customer. A line without its
    item or customer counts wherever these aren't asked for.
    """
    want = set(columns)
    o = orders(spark, folder)
    if want & _OF_PLACES:
        o = o.join(places(spark, folder), "customer_id")
    s = lines(spark, folder).join(o, "order_id")
    if want & _OF_ITEMS:
        s = s.join(items(spark, folder), "item_id")
        s = s.withColumn("cost4", F.col("qty") * F.col("cost2") * 100).withColumn("profit4", F.col("total4") - F.col("cost4"))
    return s.select(*columns)


def money(c: Column) -> Column:
    """Ten-thousandths as double."""
    return (c / F.lit(10000.0)).cast("double")


SQL = """
orders_ as (
  select o_orderkey order_id, o_custkey customer_id, o_orderpriority channel, o_orderdate::date as day, round(o_totalprice * 100)::bigint value2, o_orderstatus status from orders
), done as (select * from orders_ where status = 'F'),
places as (
  select c_custkey customer_id, n_name location, r_name region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), lines as (
  select l_orderkey order_id, l_linenumber line_no, l_partkey item_id, l_suppkey supplier_id, l_quantity::bigint qty, round(l_extendedprice * 100)::bigint * 100 gross4, round(l_discount * 100)::bigint discount2,
    round(l_extendedprice * 100)::bigint * (100 - round(l_discount * 100)::bigint) total4, l_returnflag flag, l_linestatus unit, l_shipdate::date ship_day from lineitem
), items as (
  select p_partkey item_id, p_name item_name, p_brand brand, p_type category, round(p_retailprice * 100)::bigint cost2 from part
), sales as (
  select *, qty * cost2 * 100 cost4, total4 - qty * cost2 * 100 profit4 from lines join done using (order_id) join items using (item_id) join places using (customer_id)
)
"""
