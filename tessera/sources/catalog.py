"""The tables: columns that the operators use, keys, parents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship


@dataclass(frozen=True)
class Table:
    """A table of the store: its own key, and its references as column -> (parent table, parent key)."""

    name: str
    key: str
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)


CATALOG = {
    t.name: t
    for t in (
        Table("menu_categories", "category_id"),
        Table("menu_items", "item_id", {"category_id": ("menu_categories", "category_id")}),
        Table("restaurants", "restaurant_id"),
        Table("customers", "customer_id", {"home_restaurant_id": ("restaurants", "restaurant_id")}),
        Table("restaurant_orders", "order_id", {"customer_id": ("customers", "customer_id"), "restaurant_id": ("restaurants", "restaurant_id")}),
        Table("order_items", "order_item_id", {"order_id": ("restaurant_orders", "order_id"), "item_id": ("menu_items", "item_id")}),
        Table("inventory", "inventory_id", {"restaurant_id": ("restaurants", "restaurant_id"), "item_id": ("menu_items", "item_id")}),
        Table("orders", "o_orderkey", {"o_custkey": ("customer", "c_custkey")}),
        Table("lineitem", "l_orderkey", {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
        Table("customer", "c_custkey", {"c_nationkey": ("nation", "n_nationkey")}),
        Table("supplier", "s_suppkey", {"s_nationkey": ("nation", "n_nationkey")}),
        Table("nation", "n_nationkey", {"n_regionkey": ("region", "r_regionkey")}),
        Table("region", "r_regionkey"),
        Table("part", "p_partkey"),
    )
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of a folder of Parquet tables. Only columns that the plan uses are read."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
