"""The order domain read from a star schema of parquet tables.

``orders``, ``lineitem`` and ``part`` supply orders, order lines and products. The timeline of a
user is derived: orders are numbered by date, day gaps are tenths of the date difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartwright.operators.running import RANGE, scan


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.toDF(*[c.lower() for c in df.columns])


def order_base(orders: DataFrame) -> DataFrame:
    """Orders without their position in the user's timeline: no shuffle."""
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "prior")
        .when(F.col("o_orderstatus") == "O", "train")
        .when(F.col("o_orderstatus") == "P", "test")
        .alias("eval_set"),
        F.to_date("o_orderdate").alias("order_date"),
        (F.dayofweek("o_orderdate") - 1).alias("order_dow"),
        (F.col("o_orderkey") % 24).cast("int").alias("order_hour_of_day"),
        F.col("o_totalprice").alias("total_price"),
    )


def number_orders(base: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add order_number and days_since_prior_order along each user's dates. Orders without a user are
    one timeline; a user, or a day of one, may hold any share of the orders. ``_range`` stays, for
    further scans along the timelines."""
    numbered = scan(
        base, ["user_id"], ["order_date", "order_id"], sums={"_before": F.lit(1)}, previous=["order_date"], ranges=ranges,
        keep=["order_id", "user_id", "eval_set", "order_dow", "order_hour_of_day", "order_date"],
    )
    return numbered.select(
        "order_id",
        "user_id",
        "eval_set",
        (F.col("_before") + 1).cast("int").alias("order_number"),
        "order_dow",
        "order_hour_of_day",
        F.floor(F.datediff("order_date", "previous_order_date") / 10).cast("double").alias("days_since_prior_order"),
        "order_date",
        RANGE,
    )


def raw_order_products(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("add_to_cart_order"),
        (F.col("l_returnflag") == "R").cast("int").alias("reordered"),
    )


def _lookup_id(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("int")


def raw_products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        _lookup_id(F.col("p_type")).alias("aisle_id"),
        _lookup_id(F.col("p_brand")).alias("department_id"),
    )


def shelves(part: DataFrame) -> DataFrame:
    """Products with their attributes, straight from their own rows."""
    return part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("department"), F.col("p_type").alias("aisle"))


def raw_aisles(part: DataFrame) -> DataFrame:
    names = part.select(F.col("p_type").alias("aisle")).distinct()
    return names.select(_lookup_id(F.col("aisle")).alias("aisle_id"), "aisle")


def raw_departments(part: DataFrame) -> DataFrame:
    names = part.select(F.col("p_brand").alias("department")).distinct()
    return names.select(_lookup_id(F.col("department")).alias("department_id"), "department")


# Category parameters that exist in these tables, in the shape of the default categories.
SHOP_CATEGORIES = (
    ("produce_item_ratio", "department", "brand#1"),
    ("dairy_eggs_item_ratio", "department", "brand#2"),
    ("fresh_fruits_item_ratio", "aisle", "economy"),
    ("fresh_vegetables_item_ratio", "aisle", "promo"),
)
