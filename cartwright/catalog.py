"""Named queries: every operator over the whole tables of one source folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import col

from cartwright.functions import segments as seg, text
from cartwright.operators import metrics as m, quality as dq
from cartwright.plans import decisions as dec, history, incremental, insights, marts, model_tables as mt, monitoring as mon
from cartwright.plans import training as tr
from cartwright.plans.warehouse import Warehouse
from cartwright.schemas import FEATURE_COLUMNS, MODEL_CONSTRAINTS
from cartwright.session import settle
from cartwright.sources import shop
from cartwright.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to six places, decimals as doubles."""
    out = []
    for f in df.schema.fields:
        c = col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if isinstance(f.dataType, (T.DoubleType, T.DecimalType)):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str):
    def register(build: Callable[[Warehouse], DataFrame]):
        REGISTRY[name] = lambda spark, root: tidy(build(Warehouse(spark, root)))
        return build

    return register


# Sources and projections ------------------------------------------------------------------------


@query("table_scan")
def _(w):
    return w.raw("part")


@query("param_query")
def _(w):
    return insights.query(
        w.spark,
        "select department, count(*) as products, sum(order_line_count) as lines from {products} "
        "where department <> :department and order_line_count >= :least group by department",
        {"products": w.dim_products},
        department="Brand#1",
        least=5,
    )


@query("schema_tolerant_select")
def _(w):
    return insights.select_or_null(w.feature_store.drop("reorder_order_ratio", "active_order_dow_count"))


@query("stg_orders")
def _(w):
    return w.stg_orders


@query("stg_order_products")
def _(w):
    return w.stg_order_products


@query("flag_columns")
def _(w):
    return history.order_flags(w.fct_orders).select(
        "order_id", "is_weekend_order", "is_evening_order", "has_reordered_items"
    )


@query("frequency_segment")
def _(w):
    return w.dim_users.groupBy("customer_frequency_segment").agg(F.count(F.lit(1)).alias("users"))


@query("churn_risk_segment")
def _(w):
    return w.churn.groupBy("churn_risk_segment", col("churn_probability").cast("double")).agg(
        F.count(F.lit(1)).alias("users")
    )


@query("value_segment")
def _(w):
    return w.lifetime_value.select("user_id", "value_segment")


@query("value_segment_lower_bounds")
def _(w):
    return marts.lifetime_value(w.feature_store, high=60, growth=40).select("user_id", "value_segment")


LOW_BEHAVIOUR = {"coverage": 0.95, "loyal_ratio": 0.35, "loyal_orders": 8, "risk_gap": 24, "risk_ratio": 0.30,
                 "explorer_products": 30}


@query("behaviour_segment")
def _(w):
    return insights.with_behaviour(w.feature_store).select("user_id", "customer_segment")


@query("behaviour_segment_lower_bounds")
def _(w):
    return insights.with_behaviour(w.feature_store, **LOW_BEHAVIOUR).select("user_id", "customer_segment")


@query("order_count_segment")
def _(w):
    return w.feature_store.select("user_id", seg.order_count_segment().alias("customer_segment"))


def _spenders(w: Warehouse) -> DataFrame:
    spent = w.order_base.groupBy("user_id").agg(
        F.sum("total_price").alias("total_spend"), F.count(F.lit(1)).alias("order_count")
    )
    customers = w.raw("customer").select(col("c_custkey").alias("user_id"))
    return customers.join(spent, "user_id", "left").select(
        "user_id",
        F.coalesce("total_spend", F.lit(0.0)).alias("total_spend"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
    )


@query("spend_segment")
def _(w):
    return insights.spend_intelligence(_spenders(w))


@query("average_order_value")
def _(w):
    return insights.with_average_order_value(_spenders(w))


def _written_numbers(w: Warehouse) -> DataFrame:
    """Order ids in the ways people write numbers."""
    k = col("o_orderkey")
    digits = k.cast("string")
    style = k % 5
    written = (
        F.when(style == 0, F.concat(F.lit("  "), digits, F.lit(" ")))
        .when(style == 1, F.concat(digits, F.lit("%")))
        .when(
            style == 2,
            F.concat(F.floor(k / 1000).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0")),
        )
        .when(style == 3, F.concat(F.lit("n/a "), digits))
    )
    return w.raw("orders").select(k.alias("order_id"), written.alias("written"))


@query("numeric_coercion")
def _(w):
    return _written_numbers(w).select("order_id", insights.to_number("written").alias("value"))


@query("drop_nulls")
def _(w):
    return w.stg_orders.dropna(subset=["days_since_prior_order", "user_id"]).select(
        "order_id", "days_since_prior_order"
    )


@query("metric_parse")
def _(w):
    return _written_numbers(w).select("order_id", text.parse_metric(col("written")).alias("value"))


@query("displayed_metric_parse")
def _(w):
    return _written_numbers(w).select("order_id", text.parse_displayed_metric(col("written")).alias("value"))


@query("lenient_timestamps")
def _(w):
    """Event times in the ways people write them, some of them no times at all."""
    style, ts = col("event_id") % 8, col("ts")
    ways = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd")
    written = F.when(style == 6, F.lit("soon"))
    for k, way in enumerate(ways):
        text_of = F.date_format(ts, way)
        written = written.when(style == k, F.concat(F.lit("  "), text_of) if k == 1 else text_of)
    rows = w.raw("events").select("event_id", written.alias("written"))
    return rows.select("event_id", text.lenient_timestamp(col("written")).alias("moment"))


# Joins ------------------------------------------------------------------------------------------


@query("lookup_join")
def _(w):
    return w.stg_products


@query("left_join_preagg")
def _(w):
    return w.fct_orders.select("order_id", "item_count", "reordered_item_count")


@query("filter_by_join")
def _(w):
    fresh = w.stg_orders.where(col("eval_set") == "train").select("order_id")
    return w.stg_order_products.join(fresh, "order_id", "left_semi")


@query("inner_self_agg")
def _(w):
    first = w.stg_orders.groupBy("user_id").agg(F.min("order_number").alias("cohort_order_number"))
    return w.stg_orders.join(first, "user_id").select(
        "order_id", (col("order_number") - col("cohort_order_number")).alias("cohort_period")
    )


@query("inner_1to1")
def _(w):
    features = settle(w.feature_store.select("user_id", "total_orders", "reorder_ratio", "days_between_orders", "unique_products", "avg_basket_size"))
    return features.select("user_id", "total_orders").join(
        marts.churn_probability(features).select("user_id", "churn_probability", "churn_risk_segment"), "user_id"
    )


@query("three_way_inner")
def _(w):
    return marts.user_product_features(w.fct_orders, w.stg_order_products, w.shelves, w.categories)


@query("anti_orphan")
def _(w):
    """Lines whose product is not in the catalogue, and those whose product is not in its cheap half."""
    every = w.raw("part").select(col("p_partkey").alias("product_id"), "p_retailprice")
    checks = {"product_id_valid": every, "cheap_product": every.where(col("p_retailprice") < 1000)}
    return reduce(DataFrame.unionByName, [
        dq.orphan_rows(w.stg_order_products, parent, "product_id", "raw_order_products", name) for name, parent in checks.items()
    ])


@query("inner_same_rel")
def _(w):
    return w.cohorts.select("cohort_order_number", "cohort_period", "cohort_size", "retention_rate")


@query("left_join_features")
def _(w):
    return w.feature_store.select("user_id", "total_orders", "unique_products", "unique_departments", "unique_aisles")


@query("composite_key_left")
def _(w):
    known = history.order_history(w.dealt_facts).select("user_id", "order_id", "total_orders")
    targets = w.stg_orders.where(col("eval_set") == "train").select("user_id", "order_id")
    return targets.join(known.where("total_orders >= 1"), ["user_id", "order_id"], "left")


@query("semi_in")
def _(w):
    targets = w.fct_orders.where((col("eval_set") == "train") & (col("item_count") > 0)).select("order_id")
    return w.stg_orders.join(targets, "order_id", "left_semi")


# Aggregations -----------------------------------------------------------------------------------


@query("order_lines_agg")
def _(w):
    return marts.order_line_totals(w.stg_order_products)


@query("exact_distinct")
def _(w):
    return insights.exact_distinct(w.stg_order_products)


@query("monthly_frequency")
def _(w):
    return w.dim_users.select("user_id", "order_frequency_30d")


@query("category_shares")
def _(w):
    return w.feature_store.select("user_id", *[name for name, _, _ in w.categories])


@query("smoothed_ratio")
def _(w):
    return w.feature_store.select("user_id", "reorder_ratio", "reorder_order_ratio")


@query("having_duplicates")
def _(w):
    return (
        w.stg_order_products.groupBy("order_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(col("n") > 1)
    )


@query("value_counts")
def _(w):
    return insights.value_counts(w.stg_orders, "eval_set", "orders")


@query("histogram")
def _(w):
    return insights.histogram(w.feature_store)


# Windows and history ----------------------------------------------------------------------------


@query("customer_day_number")
def _(w):
    return history.customer_day_number(w.dealt_facts)


@query("trailing_30d_count")
def _(w):
    days = history.customer_day_number(w.dealt_facts)
    return history.with_trailing_orders(days).select("order_id", "order_frequency_30d")


def _history(w: Warehouse) -> DataFrame:
    return history.order_history(w.stored_facts, w.stg_order_products, w.shelves, w.categories)


@query("prior_window_features")
def _(w):
    return history.order_history(w.dealt_facts).select(
        "order_id", "total_orders", "observed_basket_orders", "avg_basket_size", "reorder_ratio",
        "prior_reorder_order_ratio", "days_between_orders", "stddev_days_between_orders",
        "customer_tenure_days", "avg_order_dow", "avg_order_hour_of_day", "weekend_order_ratio",
        "evening_order_ratio",
    )


@query("history_range_join")
def _(w):
    return _history(w).select(
        "user_id", "order_id", "unique_products", "unique_departments", "unique_aisles",
        *[name for name, _, _ in w.categories],
    )


@query("heavy_users")
def _(w):
    """Users with more than 20 orders."""
    counts = w.order_base.groupBy(col("user_id").cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(col("n") > 20).select("user_id")


# Marts ------------------------------------------------------------------------------------------


@query("stg_customers")
def _(w):
    return w.stg_customers


@query("fct_orders")
def _(w):
    return w.fct_orders


@query("fct_orders_increment")
def _(w):
    """The increment above a mark in the middle of the ids."""
    mark = w.stg_orders.agg(F.floor(F.max("order_id") / 2).alias("v")).first().v
    return incremental.new_facts(w.stg_orders, w.stg_order_products, mark)


@query("dim_products")
def _(w):
    return w.dim_products


@query("dim_users")
def _(w):
    return w.dim_users


@query("feature_store")
def _(w):
    return w.feature_store


@query("churn_probability")
def _(w):
    return w.churn


@query("lifetime_value")
def _(w):
    return w.lifetime_value


@query("cohort_retention")
def _(w):
    return w.cohorts


@query("cohort_retention_train")
def _(w):
    return marts.cohort_retention(w.fct_orders.where(col("eval_set") == "train"))


# Insights ---------------------------------------------------------------------------------------


@query("kpis")
def _(w):
    return insights.kpis(w.fct_orders)


def _sample(w: Warehouse) -> DataFrame:
    return insights.segment_sample(insights.with_behaviour(w.feature_store))


@query("customer_insights")
def _(w):
    return _sample(w)


@query("profile_cards")
def _(w):
    return insights.profile_cards(_sample(w))


@query("customer_profile_summary")
def _(w):
    return insights.profile_summary(w.feature_store)


@query("sample_profile_summary")
def _(w):
    return insights.sample_profile_summary(_sample(w))


@query("customer_segment_summary")
def _(w):
    return insights.behaviour_segment_summary(insights.with_behaviour(w.feature_store))


@query("product_trends")
def _(w):
    return insights.product_trends(w.dim_products)


@query("top_products")
def _(w):
    return insights.top_products(w.dim_products, 20)


@query("customer_behavior_summary")
def _(w):
    return insights.behaviour_summary(w.feature_store)


@query("customer_segments_by_orders")
def _(w):
    return insights.segments_by_orders(w.feature_store)


@query("customer_segments_lower_bounds")
def _(w):
    return insights.segments_by_orders(w.feature_store, (16, 12, 8))


@query("longest_gap_users")
def _(w):
    return insights.longest_gap_users(w.feature_store)


@query("churn_by_segment")
def _(w):
    return insights.churn_by_segment(w.churn)


@query("highest_churn_users")
def _(w):
    return insights.highest_churn_users(w.churn)


@query("clv_by_segment")
def _(w):
    return insights.value_by_segment(w.lifetime_value)


@query("top_clv_customers")
def _(w):
    return insights.top_value_customers(w.lifetime_value)


@query("reorder_trend")
def _(w):
    return insights.reorder_trend(w.fct_orders)


@query("cohort_latest")
def _(w):
    return insights.latest_cohorts(w.cohorts)


@query("weakest_retention")
def _(w):
    return insights.weakest_retention(insights.latest_cohorts(w.cohorts))


@query("repeat_leader")
def _(w):
    return insights.repeat_leader(insights.top_products(w.dim_products, 20))


@query("trend_vs_average")
def _(w):
    return insights.trend_vs_average(insights.reorder_trend(w.fct_orders))


@query("longest_gap_segment")
def _(w):
    return insights.longest_gap_segment(insights.segments_by_orders(w.feature_store))


@query("highest_risk_segment")
def _(w):
    return insights.highest_risk_segment(insights.churn_by_segment(w.churn))


# Quality ----------------------------------------------------------------------------------------


def _raw_report(w: Warehouse) -> DataFrame:
    return dq.quality_report(
        dq.raw_checks(
            w.order_base,
            w.raw_products,
            w.raw_order_products,
        )
    )


@query("not_null_check")
def _(w):
    return dq.null_counts(w.stg_orders, "stg_orders", w.stg_orders.columns)


@query("unique_check")
def _(w):
    return dq.duplicate_keys(
        w.stg_order_products, "stg_order_products", ["order_id", "product_id"], "order_product_unique"
    )


@query("reference_check")
def _(w):
    return dq.orphan_rows(
        w.stg_order_products, w.stg_products, "product_id", "stg_order_products", "product_id_valid"
    )


@query("quality_report")
def _(w):
    return _raw_report(w)


@query("quality_summary")
def _(w):
    return dq.quality_summary(_raw_report(w))


def _models(w: Warehouse) -> dict[str, DataFrame]:
    return {
        "stg_orders": w.stg_orders,
        "stg_order_products": w.stg_order_products,
        "stg_products": w.stg_products,
        "stg_customers": w.stg_customers,
        "fct_orders": w.fct_orders,
        "dim_products": w.dim_products,
        "dim_users": w.dim_users,
        "feature_store": w.feature_store,
        "customer_cohort_retention": w.cohorts,
        "customer_churn_probability": w.churn,
        "customer_lifetime_value": w.lifetime_value,
    }


@query("model_constraints")
def _(w):
    return dq.model_constraints(_models(w), MODEL_CONSTRAINTS)


@query("row_count_inventory")
def _(w):
    raw = {
        "raw_orders": w.order_base,
        "raw_products": w.raw_products,
        "raw_order_products": w.raw_order_products,
        "raw_aisles": shop.raw_aisles(w.raw("part")),
        "raw_departments": shop.raw_departments(w.raw("part")),
    }
    made = {n: df for n, df in _models(w).items() if not n.startswith("stg_")}
    return dq.row_counts({**raw, **made})


# Training ---------------------------------------------------------------------------------------


@query("training_dataset")
def _(w):
    return w.training


@query("training_sort_limit")
def _(w):
    rows = history.training_dataset(
        w.stored_facts, w.stg_order_products, w.shelves, w.categories, row_limit=250_000
    )
    return rows.select("user_id", "order_id", "order_number", "will_reorder")


@query("training_matrix")
def _(w):
    return tr.training_matrix(w.training.drop("unique_aisles"))


@query("threshold_analysis")
def _(w):
    return m.threshold_analysis(w.scored)


@query("recommended_threshold")
def _(w):
    return m.recommended_threshold(m.threshold_analysis(w.scored))


@query("roc_points")
def _(w):
    return m.roc_points(w.scored)


@query("pr_points")
def _(w):
    return m.pr_points(w.scored)


@query("curve_sample")
def _(w):
    return m.curve_sample(m.pr_points(w.scored))


@query("classification_metrics")
def _(w):
    return m.classification_metrics(w.scored)


@query("confusion_rows")
def _(w):
    return m.confusion_rows(m.confusion_at_best(w.scored))


@query("classification_report")
def _(w):
    return m.classification_report(m.confusion_at_best(w.scored))


@query("stratified_split")
def _(w):
    return tr.stratified_split(w.scored.select("order_id", "label"))


@query("min_max_scores")
def _(w):
    return m.scale_scores(w.training.select("order_id", col("customer_tenure_days").alias("decision")))


@query("score_ranges")
def _(w):
    return tr.range_violations(w.training)


# Rows scored by two fixed rules, standing in for fitted models where results must be exact.
RULE_MODELS = ("reorder_ratio", "prior_reorder_order_ratio")


def _rule_scores(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(
        *keep,
        col("will_reorder").alias("label"),
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("model_name"), col(name).alias("score")) for name in RULE_MODELS
        ])),
    )


@query("model_comparison")
def _(w):
    return tr.compare_models(settle(_rule_scores(w.training)))


@query("metric_gap_flag")
def _(w):
    metrics = m.classification_metrics(settle(_rule_scores(w.training)), ["model_name"])
    return tr.metric_gap_flag(metrics).select("model_name", "metric_gap", "metric_gap_warning")


def _gap_importance(w: Warehouse) -> DataFrame:
    everything = w.training.withColumn("part", F.lit("all"))
    return mon.class_gap_importance(everything, ["part"]).select("feature", "importance")


@query("class_gap_importance")
def _(w):
    return _gap_importance(w)


@query("model_recommendations")
def _(w):
    metrics = m.classification_metrics(settle(_rule_scores(w.training)), ["model_name"])
    return tr.model_recommendations(metrics, _gap_importance(w))


@query("driver_share")
def _(w):
    return tr.driver_share(_gap_importance(w))


@query("train_candidates")
def _(w):
    _, scored = tr.fit_candidates(tr.training_matrix(w.training))
    return tr.compare_models(settle(scored))


def _fit_linear(w: Warehouse):
    rows = settle(tr.training_matrix(w.training))
    models, _ = tr.fit_candidates(rows, names=("logistic_regression",))
    return models["logistic_regression"], rows


@query("feature_importance")
def _(w):
    model, _ = _fit_linear(w)
    return tr.feature_importance(model, w.spark)


@query("batch_score")
def _(w):
    model, rows = _fit_linear(w)
    return tr.batch_score(model, rows).select("user_id", "order_id", "label", "reorder_probability")


# Fixed models in the form of stored ones, where results must be exact: a forest of two trees, three boosted
# steps and a linear model. Nodes are (tree, weight, node, feature, threshold, left, right, value, gain, rows).
_FOREST_NODES = [
    (0, 1.0, 0, "reorder_ratio", 0.45, 1, 4, 0.55, 0.12, 200.0),
    (0, 1.0, 1, "days_between_orders", 14.0, 2, 3, 0.35, 0.05, 90.0),
    (0, 1.0, 2, None, None, -1, -1, 0.48, None, 50.0),
    (0, 1.0, 3, None, None, -1, -1, 0.21, None, 40.0),
    (0, 1.0, 4, "total_orders", 6.0, 5, 6, 0.72, 0.04, 110.0),
    (0, 1.0, 5, None, None, -1, -1, 0.64, None, 60.0),
    (0, 1.0, 6, None, None, -1, -1, 0.83, None, 50.0),
    (1, 1.0, 0, "unique_products", 12.0, 1, 2, 0.5, 0.08, 200.0),
    (1, 1.0, 1, None, None, -1, -1, 0.37, None, 120.0),
    (1, 1.0, 2, "avg_basket_size", 4.5, 3, 4, 0.69, 0.06, 80.0),
    (1, 1.0, 3, None, None, -1, -1, 0.61, None, 30.0),
    (1, 1.0, 4, None, None, -1, -1, 0.74, None, 50.0),
]
_BOOSTED_NODES = [
    (0, 1.0, 0, "prior_reorder_order_ratio", 0.6, 1, 2, 0.1, 0.3, 200.0),
    (0, 1.0, 1, None, None, -1, -1, -0.7, None, 100.0),
    (0, 1.0, 2, None, None, -1, -1, 0.9, None, 100.0),
    (1, 0.05, 0, "customer_tenure_days", 90.0, 1, 2, 0.0, 0.2, 200.0),
    (1, 0.05, 1, None, None, -1, -1, -1.5, None, 70.0),
    (1, 0.05, 2, "weekend_order_ratio", 0.3, 3, 4, 0.6, 0.1, 130.0),
    (1, 0.05, 3, None, None, -1, -1, 1.2, None, 60.0),
    (1, 0.05, 4, None, None, -1, -1, 0.2, None, 70.0),
    (2, 0.05, 0, None, None, -1, -1, 0.4, None, 200.0),
]
_LINEAR_TERMS = [
    ("reorder_ratio", 0.8, 0.5, 0.2),
    ("avg_basket_size", -0.3, 4.0, 1.5),
    ("avg_order_dow", 0.25, 3.0, 0.0),
    ("days_since_last_order", -0.4, 12.0, 8.0),
    (None, 0.15, 0.0, 1.0),
]


def _fixed_models(w: Warehouse) -> dict[str, DataFrame]:
    return {
        mt.FOREST: w.spark.createDataFrame(_FOREST_NODES, mt.NODE),
        mt.BOOSTED: w.spark.createDataFrame(_BOOSTED_NODES, mt.NODE),
        mt.LINEAR: w.spark.createDataFrame(_LINEAR_TERMS, mt.TERM),
    }


def _fixed_scores(w: Warehouse) -> DataFrame:
    """Training rows scored by every fixed model: model_name, label, and score to nine places, so equal ones tie."""
    rows = tr.training_matrix(w.training)
    for kind, table in _fixed_models(w).items():
        rows = mt.score(kind, table, rows, f"by_{kind}")
    return rows.select("user_id", "order_id", "label", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("model_name"), F.round(f"by_{kind}", 9).alias("score")) for kind in _fixed_models(w)
    ])))


@query("batch_score_by_table")
def _(w):
    return _fixed_scores(w)


@query("candidate_comparison")
def _(w):
    return tr.compare_models(settle(_fixed_scores(w)))


@query("importance_by_table")
def _(w):
    """Shares within a fixed model, beside the mean of the feature over the training rows."""
    means = tr.training_matrix(w.training).agg(*[F.avg(c).alias(c) for c in FEATURE_COLUMNS]).unpivot([], FEATURE_COLUMNS, "feature", "mean")
    shares = [mt.importance(k, t).withColumn("model_name", F.lit(k)) for k, t in _fixed_models(w).items()]
    return reduce(DataFrame.unionByName, shares).join(means, "feature")


# Monitoring -------------------------------------------------------------------------------------


def _dated(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Scored rows and feature rows of one evaluation run per quarter of the target orders' dates."""
    dates = w.order_base.select(
        "order_id", F.date_trunc("quarter", "order_date").cast("timestamp_ntz").alias("run_timestamp")
    )
    rows = settle(w.training.join(dates, "order_id"))
    return settle(_rule_scores(rows, "run_timestamp")), rows


def _runs(w: Warehouse) -> DataFrame:
    return settle(mon.history_from_scores(*_dated(w)))


def _values(findings: DataFrame) -> DataFrame:
    """Finding values as numbers, and as text where they are names."""
    values = ("previous_value", "current_value")
    return findings.withColumns({
        **{v.replace("value", "name"): F.when(col("metric") == "top_feature", col(v)) for v in values},
        **{v: F.when(col("metric") != "top_feature", col(v).try_cast("double")) for v in values},
    })


@query("evaluation_record")
def _(w):
    return _runs(w)


@query("run_history")
def _(w):
    return mon.run_history(_runs(w))


@query("drift_findings")
def _(w):
    return _values(mon.drift_findings(_runs(w)))


@query("feature_drift")
def _(w):
    return _values(mon.feature_drift(_runs(w)))


@query("drift_status")
def _(w):
    status = mon.drift_status(_runs(w))
    return status.select(
        *[c for c in status.columns if c not in ("findings_json", "tracked_json")],
        F.array_join(F.transform(F.from_json("findings_json", "array<struct<metric: string>>"), lambda x: x["metric"]), ",").alias("found"),
        mon.from_report(col("tracked_json"), "$.roc_auc.delta", "double").alias("roc_auc_delta"),
        mon.from_report(col("tracked_json"), "$.brier_score.previous", "double").alias("previous_brier_score"),
        F.coalesce(F.json_array_length(F.to_json(F.map_keys(F.from_json("tracked_json", "map<string, string>")))), F.lit(0)).alias("tracked"),
    )


@query("metric_unpivot")
def _(w):
    return mon.recent_metrics(_runs(w))


@query("run_record")
def _(w):
    scored, features = _dated(w)
    history = settle(mon.history_from_scores(scored, features))
    records = mon.run_records(history, payloads=mon.payloads_from_scores(scored, features))

    def number(payload: str, path: str) -> Column:
        return mon.from_report(col(payload), path, "double")

    return records.select(
        "run_id", "run_timestamp", "selected_model", "model_selection_metric", "source_relation", "train_rows",
        "test_rows", "threshold", "top_feature",
        *[number("metrics", f"$.{c}").alias(f"{c}_in_payload") for c in ("roc_auc", "f1", "recommended_threshold", "positive_prediction_rate", "tp")],
        F.json_array_length("feature_importance").alias("features"),
        mon.from_report(col("feature_importance"), "$[0].feature").alias("first_feature"),
        number("feature_importance", "$[1].importance").alias("second_importance"),
        mon.from_report(col("model_comparison"), "$[1].model_name").alias("second_model"),
        number("model_comparison", "$[1].roc_auc").alias("second_roc_auc"),
        mon.from_report(col("drift_report"), "$.status").alias("status_in_report"),
        mon.from_report(col("drift_report"), "$.top_feature").alias("feature_in_report"),
        number("drift_report", "$.tracked_metrics.f1.current").alias("f1_in_report"),
        mon.from_report(col("drift_report"), "$.previous_run_timestamp").alias("previous_in_report"),
        F.json_array_length(F.get_json_object("drift_report", "$.findings")).alias("findings_in_report"),
    )


@query("drift_summary")
def _(w):
    summary = mon.drift_summary(settle(mon.run_records(_runs(w))))
    found = F.from_json("drift_findings_json", "array<struct<metric: string>>")
    return summary.withColumn("drift_found", F.array_join(F.transform(found, lambda x: x["metric"]), ",")).drop("drift_findings_json")


# Decisions and text -----------------------------------------------------------------------------


def _decision_input(w: Warehouse) -> DataFrame:
    """Metrics per user. The service status is unhealthy when a third of the user's events are errors."""
    status = w.raw("events").groupBy("user_id").agg(
        F.when(F.count_if(col("event_type") == "error") * 3 >= F.count(F.lit(1)), "Unhealthy")
        .otherwise("ok")
        .alias("api_health")
    )
    items = w.fct_orders.groupBy("user_id").agg(
        F.sum(F.when(col("eval_set") == "train", col("item_count")).otherwise(0)).alias("now"),
        F.sum(F.when(col("eval_set") == "prior", col("item_count")).otherwise(0)).alias("then"),
    )
    revenue = items.select("user_id", F.try_divide(col("now") - col("then"), "then").alias("revenue_delta"))
    return (
        w.feature_store.select(
            "user_id",
            col("reorder_ratio").alias("reorder_rate"),
            "days_between_orders",
            (col("total_orders") - col("observed_basket_orders")).alias("failed_checks"),
            marts.churn_score().cast("double").alias("avg_churn_probability"),
        )
        .join(revenue, "user_id", "left")
        .join(status, "user_id", "left")
        .withColumn("churn_rate", F.when(col("avg_churn_probability") > 0.5, col("avg_churn_probability")).otherwise(0.0))
    )


@query("detect_anomalies")
def _(w):
    return dec.detect_anomalies(_decision_input(w), "user_id").withColumns({
        "value": col("value").try_cast("double"),
        "value_text": F.when(col("metric") == "api_health", col("value")),
    })


@query("build_decisions")
def _(w):
    return dec.build_decisions(_decision_input(w), "user_id").drop("evidence")


@query("rank_decisions")
def _(w):
    return dec.build_decisions(_decision_input(w), "user_id").where(col("place") == 1).select(
        "user_id", "priority", "title"
    )


@query("normalize_priority")
def _(w):
    signals = dec.with_signals(_decision_input(w))

    def nth(i: int):
        return F.try_element_at("signals", F.lit(i))["severity"]

    return signals.select("user_id", dec.highest_priority(nth(1), nth(2), nth(3)).alias("priority"))


@query("decision_explanation")
def _(w):
    return dec.decision_explanations(_decision_input(w), "user_id")


@query("translate_labels")
def _(w):
    return dec.build_decisions(_decision_input(w), "user_id", "fr").select("user_id", "place", "title")


@query("decision_counts")
def _(w):
    return dec.decision_counts(_decision_input(w), "user_id")


@query("priority_mix")
def _(w):
    return dec.priority_mix(dec.build_decisions(_decision_input(w), "user_id"))


@query("operational_signals")
def _(w):
    segments = insights.behaviour_segment_summary(insights.with_behaviour(w.feature_store)).select(
        "customer_segment", col("avg_reorder_ratio").alias("reorder_rate"), "avg_days_between_orders"
    )
    ready = dec.with_operational_signals(segments, dq.quality_summary(_raw_report(w)))
    return dec.build_decisions(ready, "customer_segment").drop("evidence", "action", "rationale")


QUESTIONS = (
    "Why do more shoppers show attrition this month?",
    "How does the next cohort hold up?",
    "What is the CLV of our best shoppers?",
    "Which products sell most?",
    "How often do people repeat?",
    "Combien d'articles par panier?",
    "Le client moyen, qui est-il?",
    "La rétention baisse-t-elle?",
    "Any news today?",
)


@query("classify_questions")
def _(w):
    """User turns, each led in by one of a few questions."""
    lead = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (col("conv_id") % len(QUESTIONS) + 1).cast("int"))
    asked = w.raw("conversations").where(col("role") == "user")
    return asked.select(
        "conv_id", "turn", text.question_category(F.concat_ws(" ", lead, "text")).alias("category")
    )


@query("text_footprint")
def _(w):
    return text.text_footprint(w.raw("conversations"))


# Streams ----------------------------------------------------------------------------------------


def event_messages(w: Warehouse) -> DataFrame:
    """The events as JSON order messages. Some are cut short, some lack a field, some hold nulls."""
    k = col("event_id")
    fields = {
        "event_id": F.concat(F.lit("ev-"), k.cast("string")),
        "event_type": col("event_type"),
        "order_id": k * 7,
        "user_id": col("user_id"),
        "order_number": k % 30 + 1,
        "order_dow": k % 7,
        "order_hour_of_day": k % 24,
        "item_count": F.when(k % 50 != 3, k % 20),
        "reordered_item_count": k % 5,
        "created_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    }

    def as_json(names) -> Column:
        return F.to_json(F.struct(*[fields[n].alias(n) for n in names]), {"ignoreNullFields": "false"})

    whole = as_json(fields)
    no_user = as_json([n for n in fields if n != "user_id"])
    message = (
        F.when(k % 50 == 1, F.expr("substr(whole, 1, length(whole) div 2)"))
        .when(k % 50 == 2, col("no_user"))
        .otherwise(col("whole"))
    )
    rendered = w.raw("events").select(whole.alias("whole"), no_user.alias("no_user"), k)
    # A generator's output is not rendered again by the steps above it.
    return rendered.select(F.explode_outer(F.array(message)).alias("value"))


@query("parse_events")
def _(w):
    return events.good_events(events.parse_messages(event_messages(w)))


@query("dead_letter")
def _(w):
    bad = events.dead_letters(events.parse_messages(event_messages(w)))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))
