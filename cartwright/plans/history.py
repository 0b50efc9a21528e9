"""Leak-free training rows: what was known about a user before each target order.

Every feature is a sum over earlier orders, so one running total per measure replaces the join
of each target with its whole past. A product, department or aisle counts once, at the order in
which the user first meets it; the running total of these firsts is the distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import col

from cartwright.functions import segments as seg
from cartwright.operators.running import dealt, scan, trailing_count
from cartwright.plans.marts import product_categories
from cartwright.schemas import DEFAULT_CATEGORIES, FEATURE_COLUMNS, TARGET_COLUMN

STEP = ["user_id", "order_number"]


def order_flags(facts: DataFrame) -> DataFrame:
    return facts.withColumns({
        "is_weekend_order": seg.is_weekend(),
        "is_evening_order": seg.is_evening(),
        "has_reordered_items": seg.has_reordered(),
    })


def order_categories(lines: DataFrame, products: DataFrame, categories) -> DataFrame:
    """Per order, its lines of known products and those of each category. Lines carry flags, not names, to their order."""
    known = lines.select("order_id", "product_id").join(product_categories(products), "product_id")
    flagged = known.select("order_id", *[(col(attribute) == value).alias(f"lines_{name}") for name, attribute, value in categories])
    return dealt(flagged, "order_id").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("product_lines"),
        *[F.count_if(f"lines_{name}").alias(f"lines_{name}") for name, _, _ in categories],
    )


def first_meetings(facts: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per (user, order_number), the products, departments and aisles bought for the first time.

    The first order of a department is the first over its products' first orders, so only the
    (user, product) minima are expanded to the three kinds. A user rarely buys a product twice, so lines are
    dealt before they are grouped, and each task expands one part of them; the expanded rows are dealt likewise.
    Lines are also dealt before they meet their orders: keys in a row shrink so well that 64 MB hold millions to sort.
    """
    bought = dealt(lines.select("order_id", "product_id"), "order_id").join(facts.select("order_id", *STEP), "order_id")
    met = (
        dealt(bought.drop("order_id"), "user_id", "product_id")
        .groupBy("user_id", "product_id")
        .agg(F.min("order_number").alias("order_number"))
        .join(product_categories(products), "product_id")
    )
    kinds = {"product": "product_id", "department": "department", "aisle": "aisle"}
    named = F.array(*[
        F.struct(F.lit(kind).alias("kind"), col(name).cast("string").alias("value"))
        for kind, name in kinds.items()
    ])
    return (
        dealt(met.select(*STEP, F.inline(named)), "user_id", "kind", "value")
        .groupBy("user_id", "kind", "value")
        .agg(F.min("order_number").alias("order_number"))
        .groupBy(*STEP)
        .agg(*[F.count_if(col("kind") == kind).alias(f"new_{kind}") for kind in kinds])
    )


def customer_day_number(facts: DataFrame, ranges: int | None = None) -> DataFrame:
    """Days since the user's first order, this order's gap included."""
    gap = F.coalesce("days_since_prior_order", F.lit(0.0))
    before = scan(
        facts.withColumn("gap", gap), ["user_id"], ["order_number", "order_id"], sums={"days_before": col("gap")},
        keep=[*STEP, "order_id", "gap"], ranges=ranges,
    )
    return before.select(*STEP, "order_id", (col("days_before") + col("gap")).alias("customer_day_number"))


def with_trailing_orders(timeline: DataFrame, days: int = 30) -> DataFrame:
    """Add order_frequency_30d: the user's orders in the ``days`` days before the order's day.

    Orders are counted per day first, so a frame holds at most one row per day however many
    orders a user places; orders of the same day are not part of it. Orders without a user are
    one group. Both sides of the join must read the same day numbers, as those of ``scan`` do.
    """
    per_day = timeline.groupBy("user_id", "customer_day_number").agg(F.count(F.lit(1)).alias("n"))
    near = trailing_count(per_day, ["user_id"], "customer_day_number", "n", reach=days)
    near = near.select(
        col("user_id").alias("_user"), col("customer_day_number").alias("_day"), col("trailing").alias("order_frequency_30d")
    )
    same = col("user_id").eqNullSafe(col("_user")) & col("customer_day_number").eqNullSafe(col("_day"))
    return timeline.join(near, same, "left").drop("_user", "_day")


def order_measures() -> dict[str, Column]:
    """Additive measures of one order."""
    return {
        "p_orders": F.lit(1),
        "p_observed": (col("item_count") > 0).cast("int"),
        "p_items": col("item_count"),
        "p_reordered": col("reordered_item_count"),
        "p_with_reorder": col("has_reordered_items"),
        "p_days": col("gap"),
        "p_dow": col("order_dow"),
        "p_dow_known": col("order_dow").isNotNull().cast("int"),
        "p_hour": col("order_hour_of_day"),
        "p_hour_known": col("order_hour_of_day").isNotNull().cast("int"),
        "p_weekend": col("is_weekend_order"),
        "p_evening": col("is_evening_order"),
    }


def product_measures(shares: list[str]) -> dict[str, Column]:
    """Additive measures of the products in one order."""
    return {
        "p_products": col("new_product"),
        "p_departments": col("new_department"),
        "p_aisles": col("new_aisle"),
        "p_lines": col("product_lines"),
        **{f"p_{name}": col(f"lines_{name}") for name in shares},
    }


def order_history(
    facts: DataFrame,
    lines: DataFrame | None = None,
    products: DataFrame | None = None,
    categories=DEFAULT_CATEGORIES,
    ranges: int | None = None,
) -> DataFrame:
    """Every order with the features known before it and its label; without ``lines``, the order
    features only."""
    shares = [name for name, _, _ in categories]
    timeline = order_flags(facts).withColumn("gap", F.coalesce("days_since_prior_order", F.lit(0.0)))
    kept = ["order_id", *STEP, "eval_set", "item_count", "gap", "has_reordered_items"]
    measures = order_measures()
    if lines is not None:
        timeline = timeline.join(order_categories(lines, products, categories), "order_id", "left").join(
            first_meetings(facts, lines, products), STEP, "left"
        )
        measures |= product_measures(shares)
    before = scan(
        timeline, ["user_id"], ["order_number", "order_id"], sums=measures, spreads={"p_gaps": col("gap")}, keep=kept, ranges=ranges
    )
    before = before.withColumn("customer_day_number", col("p_days") + col("gap"))

    def ratio(top: str, bottom: str) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    n = col("p_orders")
    features = [
        "user_id",
        "order_id",
        "eval_set",
        "item_count",
        "order_number",
        n.alias("total_orders"),
        col("p_observed").alias("observed_basket_orders"),
        ratio("p_items", "p_observed").alias("avg_basket_size"),
        ratio("p_reordered", "p_items").alias("reorder_ratio"),
        ratio("p_with_reorder", "p_orders").alias("prior_reorder_order_ratio"),
        ratio("p_days", "p_orders").alias("days_between_orders"),
        F.when(n > 1, F.sqrt(F.greatest(col("p_gaps.m2") / (n - 1), F.lit(0.0)))).otherwise(0.0).alias(
            "stddev_days_between_orders"
        ),
        col("gap").alias("days_since_last_order"),
        col("p_days").alias("customer_tenure_days"),
        "order_frequency_30d",
        ratio("p_dow", "p_dow_known").alias("avg_order_dow"),
        ratio("p_hour", "p_hour_known").alias("avg_order_hour_of_day"),
        ratio("p_weekend", "p_orders").alias("weekend_order_ratio"),
        ratio("p_evening", "p_orders").alias("evening_order_ratio"),
        col("has_reordered_items").alias(TARGET_COLUMN),
    ]
    if lines is not None:
        features += [
            col("p_products").alias("unique_products"),
            col("p_departments").alias("unique_departments"),
            col("p_aisles").alias("unique_aisles"),
            *[ratio(f"p_{name}", "p_lines").alias(name) for name in shares],
        ]
    return with_trailing_orders(before).select(*features)


def targets(history: DataFrame) -> DataFrame:
    """The orders to learn from: of the train split, with observed items and at least one earlier order."""
    return history.where((col("eval_set") == "train") & (col("item_count") > 0) & (col("total_orders") >= 1))


def training_dataset(
    facts: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    categories=DEFAULT_CATEGORIES,
    row_limit: int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """The target orders with all features.

    ``row_limit`` keeps the lowest users, as a bounded sorted read would; leave it out to train
    on everything.
    """
    history = order_history(facts, lines, products, categories, ranges)
    rows = targets(history).select("user_id", "order_id", "order_number", *FEATURE_COLUMNS, TARGET_COLUMN)
    if row_limit:
        rows = rows.orderBy("user_id", "order_number").limit(row_limit)
    return rows
