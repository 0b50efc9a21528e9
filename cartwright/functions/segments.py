"""Order flags and customer segments as column expressions; first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pyspark.sql.functions import col


def is_weekend(dow: str = "order_dow") -> Column:
    return F.when(col(dow).isin(0, 6), 1).otherwise(0)


def is_evening(hour: str = "order_hour_of_day") -> Column:
    return F.when(col(hour).between(18, 23) | col(hour).between(0, 5), 1).otherwise(0)


def has_reordered(count: str = "reordered_item_count") -> Column:
    return F.when(col(count) > 0, 1).otherwise(0)


def _or_zero(name: str) -> Column:
    return F.coalesce(col(name), F.lit(0))


def frequency_segment(count: str = "order_count", high: int = 25, medium: int = 10) -> Column:
    return (
        F.when(col(count) >= high, "high_frequency")
        .when(col(count) >= medium, "medium_frequency")
        .otherwise("low_frequency")
    )


def churn_risk_segment(probability: Column) -> Column:
    """Expects a decimal: many scores lie exactly on a boundary."""
    return (
        F.when(probability >= F.lit("0.70").cast("decimal(3,2)"), "high")
        .when(probability >= F.lit("0.40").cast("decimal(3,2)"), "medium")
        .otherwise("low")
    )


def value_segment(value: Column, high: float = 500, growth: float = 150) -> Column:
    return F.when(value >= high, "high_value").when(value >= growth, "growth").otherwise("emerging")


def behaviour_segment(
    coverage: float = 0.05,
    loyal_ratio: float = 0.60,
    loyal_orders: int = 25,
    risk_gap: float = 21,
    risk_ratio: float = 0.25,
    explorer_products: int = 15,
) -> Column:
    loyal = (_or_zero("reorder_ratio") >= loyal_ratio) & (_or_zero("total_orders") >= loyal_orders)
    at_risk = (_or_zero("days_between_orders") >= risk_gap) | (_or_zero("reorder_ratio") < risk_ratio)
    return (
        F.when(_or_zero("observed_basket_coverage") < coverage, "limited_basket_detail")
        .when(loyal, "loyal_reorder")
        .when(at_risk, "at_risk_customer")
        .when(_or_zero("unique_products") >= explorer_products, "product_explorer")
        .otherwise("steady_customer")
    )


# Order-count segment names, most orders first.
ORDER_COUNT_SEGMENTS = (
    "power_customers_80_plus_orders",
    "frequent_customers_40_to_79_orders",
    "developing_customers_10_to_39_orders",
    "low_frequency_customers_under_10_orders",
)


def order_count_segment(bounds: tuple[int, int, int] = (80, 40, 10), count: str = "total_orders") -> Column:
    power, frequent, developing, low = ORDER_COUNT_SEGMENTS
    return (
        F.when(col(count) >= bounds[0], power)
        .when(col(count) >= bounds[1], frequent)
        .when(col(count) >= bounds[2], developing)
        .otherwise(low)
    )


def spend_per_order(spend: str = "total_spend", count: str = "order_count") -> Column:
    """NULL when there are no orders."""
    return F.try_divide(col(spend), col(count))


def spend_segment(spend: str = "total_spend", high: float = 1000, growth: float = 250) -> Column:
    return F.when(col(spend) >= high, "high_value").when(col(spend) >= growth, "growth").otherwise("emerging")


def spend_per_order_floored(spend: str = "total_spend", count: str = "order_count") -> Column:
    """The spend itself when there are no orders; a missing count stays missing."""
    return col(spend) / F.when(col(count) < 1, 1).otherwise(col(count))
