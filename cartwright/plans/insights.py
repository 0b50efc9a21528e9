"""Ranked and grouped readings of the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import col

from cartwright.functions import segments as seg
from cartwright.schemas import FEATURE_STORE_COLUMNS


def select_or_null(df: DataFrame, columns: dict[str, str] = FEATURE_STORE_COLUMNS) -> DataFrame:
    """The wanted columns in order; one that the table lacks becomes a typed NULL."""
    return df.select(
        *[col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    )


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """SQL with bound parameters over the given tables; no global views are registered."""
    return lower_columns(spark.sql(text, args=args or None, **tables))


def _avgs(*names: str, prefix: str = "avg_") -> list[Column]:
    return [F.avg(name).alias(prefix + name) for name in names]


def kpis(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("item_count").alias("revenue_proxy"),
        F.avg(F.try_divide("reordered_item_count", "item_count")).alias("reorder_rate"),
    )


def with_behaviour(features: DataFrame, **bounds) -> DataFrame:
    return select_or_null(features).withColumn("customer_segment", seg.behaviour_segment(**bounds))


def segment_sample(segmented: DataFrame, per_segment: int = 50) -> DataFrame:
    """A repeatable sample per segment in md5 order. The rank filter is applied map-side first,
    so no segment is gathered whole."""
    rank = F.row_number().over(
        Window.partitionBy("customer_segment").orderBy(F.md5(col("user_id").cast("string")), "user_id")
    )
    return (
        segmented.withColumn("segment_sample_rank", rank)
        .where(col("segment_sample_rank") <= per_segment)
        .orderBy("customer_segment", F.desc("total_orders"), "user_id")
    )


def profile_cards(sample: DataFrame, n: int = 12) -> DataFrame:
    return sample.orderBy("customer_segment", F.desc("total_orders"), "user_id").limit(n)


def profile_summary(features: DataFrame) -> DataFrame:
    """Eight global statistics. Rows are first combined per order count, so the exact median
    works on one weighted row per distinct count."""
    parts = ("reorder_ratio", "observed_basket_coverage", "days_between_orders", "unique_products")
    per_count = features.groupBy("total_orders").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(p).alias(f"s_{p}") for p in parts],
        *[F.count(p).alias(f"n_{p}") for p in parts],
    )
    orders = col("total_orders")
    known = F.sum(F.when(orders.isNotNull(), col("n")))
    return per_count.agg(
        F.sum("n").alias("total_customers"),
        F.try_divide(F.sum(orders * col("n")), known).alias("avg_total_orders"),
        F.expr("percentile(total_orders, 0.5, n)").alias("median_total_orders"),
        F.try_divide(F.sum("s_reorder_ratio"), F.sum("n_reorder_ratio")).alias("avg_reorder_ratio"),
        F.try_divide(
            F.sum("s_observed_basket_coverage"), F.sum("n_observed_basket_coverage")
        ).alias("avg_observed_basket_coverage"),
        F.try_divide(F.sum(F.when(orders >= 100, col("n")).otherwise(0)), F.sum("n")).alias("order_cap_share"),
        F.try_divide(F.sum("s_days_between_orders"), F.sum("n_days_between_orders")).alias(
            "avg_days_between_orders"
        ),
        F.try_divide(F.sum("s_unique_products"), F.sum("n_unique_products")).alias("avg_unique_products"),
    )


def sample_profile_summary(sample: DataFrame) -> DataFrame:
    """The same statistics from the sample: it has at most 50 rows per segment."""
    return sample.agg(
        F.count_distinct("user_id").alias("total_customers"),
        F.avg("total_orders").alias("avg_total_orders"),
        F.median("total_orders").alias("median_total_orders"),
        F.avg("reorder_ratio").alias("avg_reorder_ratio"),
        F.avg("observed_basket_coverage").alias("avg_observed_basket_coverage"),
        F.avg(F.when(col("total_orders") >= 100, 1.0).otherwise(0.0)).alias("order_cap_share"),
        F.avg("days_between_orders").alias("avg_days_between_orders"),
        F.avg("unique_products").alias("avg_unique_products"),
    )


def behaviour_segment_summary(segmented: DataFrame) -> DataFrame:
    return (
        segmented.groupBy("customer_segment")
        .agg(
            F.count(F.lit(1)).alias("users"),
            *_avgs(
                "total_orders", "reorder_ratio", "observed_basket_coverage", "unique_products",
                "days_between_orders", "order_frequency_30d",
            ),
        )
        .orderBy(F.desc("users"), "customer_segment")
    )


def top_products(products: DataFrame, n: int, ratio_name: str = "reorder_ratio") -> DataFrame:
    return (
        products.orderBy(F.desc("order_line_count"), "product_id")
        .limit(n)
        .select(
            "product_id", "product_name", "department", "aisle", "order_line_count", "reordered_line_count",
            F.try_divide("reordered_line_count", "order_line_count").alias(ratio_name),
        )
    )


def product_trends(products: DataFrame, n: int = 25) -> DataFrame:
    return top_products(products, n, "reorder_rate").drop("product_id")


def behaviour_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.avg("total_orders").alias("avg_total_orders"),
        F.avg("avg_basket_size").alias("avg_basket_size"),
        *_avgs("reorder_ratio", "unique_products", "days_between_orders"),
    )


def segments_by_orders(features: DataFrame, bounds: tuple[int, int, int] = (80, 40, 10)) -> DataFrame:
    return (
        features.withColumn("customer_segment", seg.order_count_segment(bounds))
        .groupBy("customer_segment")
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.avg("total_orders").alias("avg_total_orders"),
            F.avg("avg_basket_size").alias("avg_basket_size"),
            *_avgs("reorder_ratio", "unique_products", "days_between_orders"),
            F.max("days_between_orders").alias("max_days_between_orders"),
        )
        .orderBy(F.desc("avg_days_between_orders"), "customer_segment")
    )


def longest_gap_users(features: DataFrame, n: int = 20) -> DataFrame:
    return (
        features.select(
            "user_id", "total_orders", "observed_basket_orders", "avg_basket_size", "reorder_ratio",
            "unique_products", "days_between_orders",
        )
        .orderBy(F.desc_nulls_first("days_between_orders"), "user_id")
        .limit(n)
    )


def reorder_trend(facts: DataFrame, n: int = 20) -> DataFrame:
    """Latest order numbers only: the cut is taken before the averages are finished."""
    return (
        facts.groupBy("order_number")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.avg("item_count").alias("avg_basket_size"),
            F.avg(F.try_divide("reordered_item_count", "item_count")).alias("reorder_ratio"),
        )
        .orderBy(F.desc("order_number"))
        .limit(n)
    )


def churn_by_segment(churn: DataFrame) -> DataFrame:
    return (
        churn.groupBy("churn_risk_segment")
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.avg(col("churn_probability").cast("double")).alias("avg_churn_probability"),
            F.avg("total_orders").alias("avg_total_orders"),
            F.avg("avg_basket_size").alias("avg_basket_size"),
            *_avgs("reorder_ratio", "unique_products", "days_between_orders"),
        )
        .orderBy(F.desc("avg_churn_probability"), "churn_risk_segment")
    )


def highest_churn_users(churn: DataFrame, n: int = 25) -> DataFrame:
    return churn.orderBy(F.desc("churn_probability"), "user_id").limit(n)


def latest_cohorts(cohorts: DataFrame, n: int = 50) -> DataFrame:
    return (
        cohorts.select(
            "cohort_order_number", "cohort_period", "cohort_size", "active_users", "retention_rate",
            "revenue_proxy",
        )
        .orderBy(F.desc("cohort_order_number"), "cohort_period")
        .limit(n)
    )


def value_by_segment(value: DataFrame) -> DataFrame:
    return (
        value.groupBy("value_segment")
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.avg("customer_lifetime_value_proxy").alias("avg_lifetime_value_proxy"),
            F.avg("historical_value_proxy").alias("avg_historical_value_proxy"),
            F.avg("predicted_future_value_proxy").alias("avg_future_value_proxy"),
            F.avg(col("churn_probability").cast("double")).alias("avg_churn_probability"),
        )
        .orderBy(F.desc("avg_lifetime_value_proxy"), "value_segment")
    )


def top_value_customers(value: DataFrame, n: int = 25) -> DataFrame:
    return (
        value.select(
            "user_id", "value_segment", "customer_lifetime_value_proxy", "historical_value_proxy",
            "predicted_future_value_proxy", "churn_probability", "churn_risk_segment",
        )
        .orderBy(F.desc("customer_lifetime_value_proxy"), "user_id")
        .limit(n)
    )


def spend_intelligence(customers: DataFrame) -> DataFrame:
    """Average order value and spend class of customers that carry total_spend and order_count."""
    return customers.withColumns({
        "average_order_value": seg.spend_per_order(),
        "customer_segment": seg.spend_segment(),
    })


def with_average_order_value(customers: DataFrame) -> DataFrame:
    """Added only when both inputs exist."""
    if {"total_spend", "order_count"} <= set(customers.columns):
        return customers.withColumn("average_order_value", seg.spend_per_order_floored())
    return customers


# Selections over one ranked reading ------------------------------------------------------------


def weakest_retention(latest: DataFrame) -> DataFrame:
    """The first row's rate and the row with the lowest rate (the earlier row wins a tie). The
    input has at most 50 rows."""
    cell = F.struct(
        F.coalesce("retention_rate", F.lit(1.0)), -col("cohort_order_number"), col("cohort_period")
    )
    first = F.struct(-col("cohort_order_number"), col("cohort_period"))
    return latest.agg(
        F.min_by("cohort_order_number", cell).alias("cohort_order_number"),
        F.min_by("cohort_period", cell).alias("cohort_period"),
        F.coalesce(F.min_by("retention_rate", cell), F.lit(0.0)).alias("lowest_rate"),
        F.coalesce(F.min_by("retention_rate", first), F.lit(0.0)).alias("latest_rate"),
    )


def repeat_leader(top: DataFrame) -> DataFrame:
    volume = F.struct(-col("order_line_count"), col("product_id"))
    repeat = F.struct(-F.coalesce("reorder_ratio", F.lit(0.0)), -col("order_line_count"), col("product_id"))
    return top.agg(
        F.min_by("product_name", volume).alias("volume_leader"),
        F.max("order_line_count").alias("volume_leader_lines"),
        F.min_by("product_name", repeat).alias("repeat_leader"),
        F.min_by("product_id", repeat).alias("repeat_leader_id"),
        F.coalesce(F.min_by("reorder_ratio", repeat), F.lit(0.0)).alias("repeat_leader_ratio"),
    )


def trend_vs_average(trend: DataFrame) -> DataFrame:
    latest = F.coalesce(F.max_by("reorder_ratio", "order_number"), F.lit(0.0))
    recent = F.coalesce(F.avg("reorder_ratio"), F.lit(0.0))
    return trend.agg(latest.alias("latest_ratio"), recent.alias("average_ratio")).withColumn(
        "direction", F.when(col("latest_ratio") >= col("average_ratio"), "above").otherwise("below")
    )


def longest_gap_segment(segments: DataFrame) -> DataFrame:
    rank = F.struct(-F.coalesce("avg_days_between_orders", F.lit(0.0)), col("customer_segment"))
    return segments.agg(
        F.min_by("customer_segment", rank).alias("customer_segment"),
        F.min_by("users", rank).alias("users"),
        F.min_by("avg_days_between_orders", rank).alias("avg_days_between_orders"),
    ).withColumn("gap_text", F.format_number("avg_days_between_orders", 2))


def highest_risk_segment(churn_segments: DataFrame) -> DataFrame:
    """The high class if present, else the class with the largest probability."""
    rank = F.struct(
        (col("churn_risk_segment") != "high").cast("int"), -col("avg_churn_probability"), col("churn_risk_segment")
    )
    return churn_segments.agg(
        *[
            F.min_by(c, rank).alias(c)
            for c in ("churn_risk_segment", "users", "avg_churn_probability", "avg_days_between_orders")
        ]
    )


def histogram(features: DataFrame, column: str = "total_orders", max_bins: int = 18) -> DataFrame:
    """Counts per bin of a round width (1, 2 or 5 times a power of ten) with at most ``max_bins``.

    Values are counted first; the extent is taken from these counts, not from the rows.
    """
    counts = features.where(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    widths = F.array(*[F.lit(float(m * 10**p)) for p in range(0, 13) for m in (1, 2, 5)])
    span = F.max("v") - F.min("v")
    width = counts.agg(F.filter(widths, lambda w: span / w <= max_bins)[0].alias("w")).scalar()
    return (
        counts.withColumn("bin_start", F.floor(col("v") / width) * width)
        .groupBy("bin_start")
        .agg(F.sum("n").alias("users"))
    )


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def metric_unpivot(df: DataFrame, ids: list[str], columns: list[str], value: str = "value") -> DataFrame:
    """Wide metrics to (ids, metric, value) for the columns that exist."""
    present = [c for c in columns if c in df.columns]
    return df.select(*ids, *[col(c).cast("double") for c in present]).unpivot(ids, present, "metric", value)


def to_number(column: str) -> Column:
    """NULL where the text is no number."""
    return col(column).try_cast("double")


# Packs per question category -------------------------------------------------------------------

# The readings that answer a question of each category.
PACK_CONTENTS = {
    "churn": (
        "churn_by_segment", "highest_churn_users", "cohort_retention", "customer_behavior",
        "customer_segments", "customers_with_longest_order_gaps",
    ),
    "reorder_trend": ("reorder_trend",),
    "top_products": ("top_products",),
    "customer_behavior": ("customer_behavior", "customer_segments", "customers_with_longest_order_gaps"),
    "retention": ("cohort_retention",),
    "clv": ("lifetime_value_by_segment", "top_lifetime_value_customers"),
}


def metric_pack(warehouse, category: str) -> dict[str, DataFrame]:
    """The lazy readings of a category; ``general`` holds all of them."""
    build = {
        "churn_by_segment": lambda: churn_by_segment(warehouse.churn),
        "highest_churn_users": lambda: highest_churn_users(warehouse.churn),
        "cohort_retention": lambda: latest_cohorts(warehouse.cohorts),
        "customer_behavior": lambda: behaviour_summary(warehouse.feature_store),
        "customer_segments": lambda: segments_by_orders(warehouse.feature_store),
        "customers_with_longest_order_gaps": lambda: longest_gap_users(warehouse.feature_store),
        "reorder_trend": lambda: reorder_trend(warehouse.fct_orders),
        "top_products": lambda: top_products(warehouse.dim_products, 20),
        "lifetime_value_by_segment": lambda: value_by_segment(warehouse.lifetime_value),
        "top_lifetime_value_customers": lambda: top_value_customers(warehouse.lifetime_value),
    }
    names = build if category == "general" else PACK_CONTENTS.get(category, ())
    return {name: build[name]() for name in names}


def _bitmaps(df: DataFrame, column: str) -> DataFrame:
    """Per block of 32,768 ids, the bits of those that occur: one row of 4 KB however often they do."""
    return df.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(column).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits")
    )


def exact_distinct(lines: DataFrame) -> DataFrame:
    """Exact numbers of orders, products and (order, product) pairs in the lines.

    Ids set bits in bitmaps, merged by block before they are counted, so no line is copied per count. An
    order's lines are deduplicated where they are: the pairs of an order are the products it has.
    """

    def ids(column: str) -> Column:
        return _bitmaps(lines, column).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).scalar()

    known = lines.where(F.col("order_id").isNotNull() & F.col("product_id").isNotNull())
    pairs = known.select("order_id", "product_id").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    return pairs.select(ids("order_id").alias("orders"), ids("product_id").alias("products"), "pairs")
