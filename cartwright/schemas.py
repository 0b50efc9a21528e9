"""Column lists, table schemas and constraints shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# The model's feature vector, in its serving order.
FEATURE_COLUMNS = [
    "total_orders",
    "observed_basket_orders",
    "avg_basket_size",
    "reorder_ratio",
    "days_between_orders",
    "stddev_days_between_orders",
    "days_since_last_order",
    "customer_tenure_days",
    "order_frequency_30d",
    "avg_order_dow",
    "avg_order_hour_of_day",
    "weekend_order_ratio",
    "evening_order_ratio",
    "prior_reorder_order_ratio",
    "unique_products",
    "unique_departments",
    "unique_aisles",
    "produce_item_ratio",
    "dairy_eggs_item_ratio",
    "fresh_fruits_item_ratio",
    "fresh_vegetables_item_ratio",
]
TARGET_COLUMN = "will_reorder"

# Largest legal value per feature where one exists; every feature is >= 0.
FEATURE_UPPER_BOUNDS = {
    "reorder_ratio": 1.0,
    "prior_reorder_order_ratio": 1.0,
    "produce_item_ratio": 1.0,
    "dairy_eggs_item_ratio": 1.0,
    "fresh_fruits_item_ratio": 1.0,
    "fresh_vegetables_item_ratio": 1.0,
    "avg_order_dow": 6.0,
    "avg_order_hour_of_day": 23.0,
    "weekend_order_ratio": 1.0,
    "evening_order_ratio": 1.0,
}

# Item-share features as (column, product attribute, lower-cased value).
DEFAULT_CATEGORIES = (
    ("produce_item_ratio", "department", "produce"),
    ("dairy_eggs_item_ratio", "department", "dairy eggs"),
    ("fresh_fruits_item_ratio", "aisle", "fresh fruits"),
    ("fresh_vegetables_item_ratio", "aisle", "fresh vegetables"),
)

# The feature store as readers expect it, with the type of a column that is absent.
FEATURE_STORE_COLUMNS = {
    "user_id": "bigint",
    "total_orders": "bigint",
    "observed_basket_orders": "bigint",
    "avg_basket_size": "double",
    "stddev_basket_size": "double",
    "reorder_ratio": "double",
    "reorder_order_ratio": "double",
    "unique_products": "bigint",
    "unique_departments": "bigint",
    "unique_aisles": "bigint",
    "produce_item_ratio": "double",
    "dairy_eggs_item_ratio": "double",
    "fresh_fruits_item_ratio": "double",
    "fresh_vegetables_item_ratio": "double",
    "days_between_orders": "double",
    "stddev_days_between_orders": "double",
    "customer_tenure_days": "double",
    "max_days_between_orders": "double",
    "avg_order_dow": "double",
    "order_frequency_30d": "double",
    "avg_order_hour_of_day": "double",
    "weekend_order_ratio": "double",
    "evening_order_ratio": "double",
    "active_order_dow_count": "bigint",
    "observed_basket_coverage": "double",
    "will_reorder": "int",
}

# Columns and types of the raw tables.
RAW_SCHEMAS = {
    "raw_orders": T.StructType([
        T.StructField("order_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("eval_set", T.StringType()),
        T.StructField("order_number", T.IntegerType()),
        T.StructField("order_dow", T.IntegerType()),
        T.StructField("order_hour_of_day", T.IntegerType()),
        T.StructField("days_since_prior_order", T.DoubleType()),
    ]),
    "raw_order_products": T.StructType([
        T.StructField("order_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("add_to_cart_order", T.IntegerType()),
        T.StructField("reordered", T.IntegerType()),
    ]),
    "raw_products": T.StructType([
        T.StructField("product_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("aisle_id", T.IntegerType()),
        T.StructField("department_id", T.IntegerType()),
    ]),
    "raw_aisles": T.StructType([
        T.StructField("aisle_id", T.IntegerType()),
        T.StructField("aisle", T.StringType()),
    ]),
    "raw_departments": T.StructType([
        T.StructField("department_id", T.IntegerType()),
        T.StructField("department", T.StringType()),
    ]),
}

# Source file of each raw table.
RAW_FILES = {
    "orders.csv": "raw_orders",
    "order_products__train.csv": "raw_order_products",
    "products.csv": "raw_products",
    "aisles.csv": "raw_aisles",
    "departments.csv": "raw_departments",
}

# Declared data tests, table -> (unique column or None, columns that must not be null).
MODEL_CONSTRAINTS = {
    "stg_orders": ("order_id", ["order_id", "user_id"]),
    "stg_order_products": ("order_product_id", ["order_product_id", "order_id", "product_id"]),
    "stg_products": ("product_id", ["product_id", "product_name"]),
    "stg_customers": ("user_id", ["user_id", "order_count"]),
    "fct_orders": ("order_id", ["order_id", "user_id"]),
    "dim_products": ("product_id", ["product_id", "product_name"]),
    "dim_users": ("user_id", ["user_id", "order_count", "order_frequency_30d", "customer_frequency_segment"]),
    "feature_store": (
        "user_id",
        [name for name in FEATURE_STORE_COLUMNS if name not in ("days_between_orders", "reorder_order_ratio")],
    ),
    "customer_cohort_retention": (None, ["cohort_order_number", "cohort_period", "retention_rate"]),
    "customer_churn_probability": ("user_id", ["user_id", "churn_probability", "churn_risk_segment"]),
    "customer_lifetime_value": ("user_id", ["user_id", "customer_lifetime_value_proxy", "value_segment"]),
}

# Metrics compared from run to run.
TRACKED_METRICS = (
    "accuracy",
    "balanced_accuracy",
    "precision",
    "recall",
    "f1",
    "roc_auc",
    "average_precision",
    "brier_score",
    "positive_rate",
)

# Columns and types of the run history.
RUN_HISTORY_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("run_timestamp", T.TimestampType(), False),
    T.StructField("selected_model", T.StringType()),
    T.StructField("model_selection_metric", T.StringType()),
    T.StructField("source_relation", T.StringType()),
    T.StructField("model_artifact_path", T.StringType()),
    T.StructField("model_artifact_uri", T.StringType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("test_rows", T.LongType()),
    T.StructField("positive_rate", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("balanced_accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("average_precision", T.DoubleType()),
    T.StructField("brier_score", T.DoubleType()),
    T.StructField("top_feature", T.StringType()),
    T.StructField("top_feature_importance", T.DoubleType()),
    T.StructField("metrics", T.StringType()),
    T.StructField("feature_importance", T.StringType()),
    T.StructField("model_comparison", T.StringType()),
    T.StructField("drift_report", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

# Fields of an order event.
ORDER_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("order_number", T.LongType()),
    T.StructField("order_dow", T.LongType()),
    T.StructField("order_hour_of_day", T.LongType()),
    T.StructField("item_count", T.LongType()),
    T.StructField("reordered_item_count", T.LongType()),
    T.StructField("created_at", T.StringType()),
])
