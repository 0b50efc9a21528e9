"""Staging views: typed projections and the per-user order profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stg_orders(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    return raw.select(
        F.col("order_id").cast("bigint"),
        F.col("user_id").cast("bigint"),
        F.col("eval_set").cast("string"),
        F.col("order_number").cast("int"),
        F.col("order_dow").cast("int"),
        F.col("order_hour_of_day").cast("int"),
        F.col("days_since_prior_order").cast("double"),
        *keep,
    )


def stg_order_products(raw: DataFrame) -> DataFrame:
    # concat, not concat_ws: a missing key part must make the whole key NULL.
    return raw.select(
        F.concat(F.col("order_id").cast("string"), F.lit("-"), F.col("product_id").cast("string")).alias(
            "order_product_id"
        ),
        F.col("order_id").cast("bigint"),
        F.col("product_id").cast("bigint"),
        F.col("add_to_cart_order").cast("int"),
        F.col("reordered").cast("int"),
    )


def stg_products(products: DataFrame, aisles: DataFrame, departments: DataFrame) -> DataFrame:
    """Lookups carry no broadcast hint: their measured size decides."""
    return (
        products.join(aisles, "aisle_id", "left")
        .join(departments, "department_id", "left")
        .select(
            F.col("product_id").cast("bigint"),
            F.col("product_name").cast("string"),
            F.col("aisle_id").cast("int"),
            F.col("aisle").cast("string"),
            F.col("department_id").cast("int"),
            F.col("department").cast("string"),
        )
    )


def stg_customers(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.min("order_number").alias("first_order_number"),
            F.max("order_number").alias("last_order_number"),
            F.min("order_dow").alias("first_observed_order_dow"),
            F.max("order_dow").alias("last_observed_order_dow"),
            F.avg("order_dow").alias("avg_order_dow"),
            F.avg("order_hour_of_day").alias("avg_order_hour_of_day"),
            F.avg("days_since_prior_order").alias("avg_days_since_prior_order"),
            *[
                F.count_if(F.col("eval_set") == part).alias(f"{part}_order_count")
                for part in ("prior", "train", "test")
            ],
        )
    )
