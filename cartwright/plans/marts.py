"""Marts: order fact, dimensions, feature store, cohorts, churn and lifetime value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartwright.functions import segments as seg
from cartwright.schemas import DEFAULT_CATEGORIES



def order_line_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("reordered").alias("reordered_item_count"),
        F.min("add_to_cart_order").alias("first_cart_position"),
        F.max("add_to_cart_order").alias("last_cart_position"),
    )


def fct_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per order; an order without lines has 0 items, which means unobserved."""
    return orders.join(order_line_totals(lines), "order_id", "left").select(
        *orders.columns,
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("reordered_item_count", F.lit(0)).alias("reordered_item_count"),
        "first_cart_position",
        "last_cart_position",
    )


def dim_products(products: DataFrame, lines: DataFrame) -> DataFrame:
    totals = lines.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("order_line_count"),
        F.sum("reordered").alias("reordered_line_count"),
    )
    return products.join(totals, "product_id", "left").select(
        *products.columns,
        F.coalesce("order_line_count", F.lit(0)).alias("order_line_count"),
        F.coalesce("reordered_line_count", F.lit(0)).alias("reordered_line_count"),
    )


def monthly_frequency(orders: Column, days: Column) -> Column:
    """Orders per 30 days, or the order count when no day has passed."""
    return F.when(days > 0, orders / (days / 30)).otherwise(orders.cast("double"))


def dim_users(facts: DataFrame) -> DataFrame:
    gap = "days_since_prior_order"
    per_user = facts.groupBy("user_id").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.count_if(F.col("item_count") > 0).alias("observed_basket_orders"),
        F.min("order_number").alias("first_order_number"),
        F.max("order_number").alias("latest_order_number"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_days_since_prior_order"),
        F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("stddev_days_since_prior_order"),
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("customer_tenure_days"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_days_since_prior_order"),
        F.coalesce(F.avg("order_dow"), F.lit(0.0)).alias("avg_order_dow"),
        F.coalesce(F.avg("order_hour_of_day"), F.lit(0.0)).alias("avg_order_hour_of_day"),
        F.avg(seg.is_weekend()).alias("weekend_order_ratio"),
        F.avg(seg.is_evening()).alias("evening_order_ratio"),
        F.sum("item_count").alias("total_items_ordered"),
        F.sum("reordered_item_count").alias("total_reordered_items"),
    )
    items, reordered = F.col("total_items_ordered"), F.col("total_reordered_items")
    return per_user.withColumns({
        "reorder_item_ratio": F.when(items > 0, F.try_divide(reordered, items)).otherwise(0.0),
        "order_frequency_30d": monthly_frequency(F.col("order_count"), F.col("customer_tenure_days")),
        "customer_frequency_segment": seg.frequency_segment(),
    })


def user_order_features(facts: DataFrame) -> DataFrame:
    gap = "days_since_prior_order"
    basket = F.nullif(F.col("item_count"), F.lit(0))
    sums = facts.groupBy("user_id").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.count_if(F.col("item_count") > 0).alias("observed_basket_orders"),
        F.coalesce(F.avg(basket), F.lit(0.0)).alias("avg_basket_size"),
        F.coalesce(F.stddev_samp(basket), F.lit(0.0)).alias("stddev_basket_size"),
        F.sum("item_count").alias("_items"),
        F.sum("reordered_item_count").alias("_reordered"),
        F.avg(seg.has_reordered()).alias("reorder_order_ratio"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("days_between_orders"),
        F.coalesce(F.stddev_samp(gap), F.lit(0.0)).alias("stddev_days_between_orders"),
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("customer_tenure_days"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_days_between_orders"),
        F.coalesce(F.avg("order_dow"), F.lit(0.0)).alias("avg_order_dow"),
        F.coalesce(F.avg("order_hour_of_day"), F.lit(0.0)).alias("avg_order_hour_of_day"),
        F.avg(seg.is_weekend()).alias("weekend_order_ratio"),
        F.avg(seg.is_evening()).alias("evening_order_ratio"),
        # Weekdays are 0-6: a bit set counts them without the row expansion of a second distinct.
        F.coalesce(F.bit_count(F.bit_or(F.expr("shiftleft(1L, order_dow)"))), F.lit(0)).cast("bigint")
        .alias("active_order_dow_count"),
    )
    orders = F.col("total_orders")
    return sums.withColumns({
        "reorder_ratio": F.when(
            F.col("_items") > 0, (F.col("_reordered") + F.lit(0.5)) / (F.col("_items") + 1)
        ).otherwise(0.0),
        "observed_basket_coverage": F.when(
            orders > 0, F.try_divide(F.col("observed_basket_orders"), orders)
        ).otherwise(0.0),
        "order_frequency_30d": monthly_frequency(orders, F.col("customer_tenure_days")),
        "will_reorder": seg.has_reordered("_reordered"),
    }).drop("_items", "_reordered")


def product_categories(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        F.lower(F.coalesce("department", F.lit("unknown"))).alias("department"),
        F.lower(F.coalesce("aisle", F.lit("unknown"))).alias("aisle"),
    )


def user_product_features(
    facts: DataFrame, lines: DataFrame, products: DataFrame, categories=DEFAULT_CATEGORIES
) -> DataFrame:
    """Breadth and category shares, narrowed in steps.

    Lines shrink to (user, product) pairs before the product join, and to one row per (user,
    attribute, value) before the user totals. Every key but the last also holds the product or its
    attribute, so a user with a third of all lines is spread out, and no distinct count is needed.
    """
    pairs = (
        lines.select("order_id", "product_id")
        .join(facts.select("order_id", "user_id"), "order_id")
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    attributes = ("department", "aisle")
    shelves = (
        pairs.join(product_categories(products), "product_id")
        .select("user_id", "n", F.explode(F.array(*[
            F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes
        ])).alias("s"))
        .groupBy("user_id", "s.attribute", "s.value")
        .agg(F.count(F.lit(1)).alias("products"), F.sum("n").alias("n"))
    )

    def of(attribute: str, value: Column) -> Column:
        return F.sum(F.when(F.col("attribute") == attribute, value).otherwise(0))

    return shelves.groupBy("user_id").agg(
        of("department", F.col("products")).alias("unique_products"),
        of("department", F.lit(1).cast("bigint")).alias("unique_departments"),
        of("aisle", F.lit(1).cast("bigint")).alias("unique_aisles"),
        *[
            (
                of(attribute, F.when(F.col("value") == value, F.col("n")).otherwise(0))
                / of(attribute, F.col("n"))
            ).alias(name)
            for name, attribute, value in categories
        ],
    )


def feature_store(
    facts: DataFrame, lines: DataFrame, products: DataFrame, categories=DEFAULT_CATEGORIES
) -> DataFrame:
    breadth = user_product_features(facts, lines, products, categories)
    shares = [name for name, _, _ in categories]
    return user_order_features(facts).join(breadth, "user_id", "left").select(
        "user_id",
        "total_orders",
        "observed_basket_orders",
        "avg_basket_size",
        "stddev_basket_size",
        "reorder_ratio",
        "reorder_order_ratio",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unique_products", "unique_departments", "unique_aisles")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in shares],
        "days_between_orders",
        "stddev_days_between_orders",
        "customer_tenure_days",
        "max_days_between_orders",
        "avg_order_dow",
        "avg_order_hour_of_day",
        "weekend_order_ratio",
        "evening_order_ratio",
        "active_order_dow_count",
        "observed_basket_coverage",
        "order_frequency_30d",
        "will_reorder",
    )


def churn_score() -> Column:
    """Rule score of a feature row in exact decimals; a missing input takes the rule's second value."""

    def money(text: str) -> Column:
        return F.lit(text).cast("decimal(3,2)")

    # Fixed values: (condition, added when true, added otherwise).
    rules = (
        (F.col("total_orders") <= 2, "0.20", "-0.10"),
        (F.col("reorder_ratio") < 0.20, "0.20", "-0.15"),
        (F.col("days_between_orders") > 14, "0.20", "-0.05"),
        (F.col("unique_products") <= 5, "0.10", "-0.05"),
    )
    score = money("0.50")
    for condition, when_true, otherwise in rules:
        score = score + F.when(condition, money(when_true)).otherwise(money(otherwise))
    return F.least(money("0.95"), F.greatest(money("0.05"), score)).cast("decimal(4,2)")


def churn_probability(features: DataFrame) -> DataFrame:
    return (
        features.select(
            "user_id",
            "total_orders",
            "avg_basket_size",
            "reorder_ratio",
            "unique_products",
            "days_between_orders",
            churn_score().alias("churn_probability"),
        )
        .withColumn("churn_risk_segment", seg.churn_risk_segment(F.col("churn_probability")))
    )


def lifetime_value(features: DataFrame, high: float = 500, growth: float = 150) -> DataFrame:
    """Value proxies from basket size and churn. The score is a function of the same row, so it is
    computed in place: the one-to-one join of features and churn needs no shuffle here."""
    orders, basket = F.col("total_orders"), F.col("avg_basket_size")
    stay = F.lit(1) - F.col("churn_probability")
    total = F.col("historical_value_proxy") + F.col("predicted_future_value_proxy")
    return (
        churn_probability(features)
        .withColumns({
            "historical_value_proxy": orders * basket,
            "predicted_future_value_proxy": basket
            * F.greatest(F.lit(1.0), (orders * stay).cast("double")),
        })
        .withColumn("customer_lifetime_value_proxy", total)
        .withColumn("value_segment", seg.value_segment(F.col("customer_lifetime_value_proxy"), high, growth))
    )


def cohort_retention(facts: DataFrame) -> DataFrame:
    """Retention by first order number and steps since.

    Grouping by (user, order_number) first makes the distinct user count a plain count.
    """
    steps = facts.groupBy("user_id", "order_number").agg(
        F.count_distinct("order_id").alias("orders"), F.sum("item_count").alias("items")
    )
    first = facts.groupBy("user_id").agg(F.min("order_number").alias("cohort_order_number"))
    # Every user is active in period 0, so the cohort size is its number of users.
    sizes = first.groupBy("cohort_order_number").agg(F.count("user_id").alias("cohort_size"))
    activity = (
        steps.join(first, "user_id")
        .groupBy(
            "cohort_order_number",
            (F.col("order_number") - F.col("cohort_order_number")).alias("cohort_period"),
        )
        .agg(
            F.count("user_id").alias("active_users"),
            F.sum("orders").alias("orders_count"),
            F.sum("items").alias("revenue_proxy"),
        )
    )
    return activity.join(sizes, "cohort_order_number").select(
        "cohort_order_number",
        "cohort_period",
        "cohort_size",
        "active_users",
        "orders_count",
        "revenue_proxy",
        F.try_divide("active_users", "cohort_size").alias("retention_rate"),
    )
