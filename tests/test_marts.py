"""Edge rows of the marts, checked by hand."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F

from cartwright.functions import segments as seg
from cartwright.operators import quality as dq
from cartwright.operators.running import RANGE
from cartwright.plans import incremental, insights, marts, staging
from cartwright.plans.history import first_meetings, order_categories, training_dataset
from cartwright.plans.warehouse import Warehouse
from cartwright.schemas import FEATURE_STORE_COLUMNS

ORDERS = "order_id long, user_id long, eval_set string, order_number int, order_dow int, " \
    "order_hour_of_day int, days_since_prior_order double"
LINES = "order_id long, product_id long, add_to_cart_order int, reordered int"
PRODUCTS = "product_id long, product_name string, aisle_id int, aisle string, department_id int, department string"


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame([
        (1, 1, "prior", 1, 0, 23, None),
        (2, 1, "train", 2, 6, 5, 10.0),
        (3, 1, "train", 3, 3, 12, 0.0),
        (4, 2, "train", 1, 2, 9, None),
        (5, 3, "prior", 1, 1, 18, None),
        (6, 3, "train", 2, 1, 17, 31.0),
    ], ORDERS)
    lines = spark.createDataFrame([
        (1, 10, 1, 0), (1, 11, 2, 0), (2, 10, 1, 1), (3, 12, 1, 0), (3, 12, 2, 0), (6, 99, 1, 1),
    ], LINES)
    products = spark.createDataFrame([
        (10, "pear", 1, "Fresh Fruits", 4, "Produce"),
        (11, "milk", 2, "milk", 16, "Dairy Eggs"),
        (12, "thing", 3, None, 5, None),
    ], PRODUCTS)
    return orders, lines, products


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}


def test_order_without_lines_has_zero_items(shop):
    facts = rows_by(marts.fct_orders(shop[0], shop[1]), "order_id")
    assert (facts[4].item_count, facts[4].reordered_item_count, facts[4].first_cart_position) == (0, 0, None)
    assert (facts[3].item_count, facts[3].last_cart_position) == (2, 2)


def test_feature_store_edges(shop):
    facts = marts.fct_orders(shop[0], shop[1])
    features = rows_by(marts.feature_store(facts, shop[1], shop[2]), "user_id")
    one, two, three = features[1], features[2], features[3]
    assert one.unique_products == 3 and one.unique_departments == 3 and one.unique_aisles == 3
    assert one.produce_item_ratio == pytest.approx(2 / 5)
    assert one.reorder_ratio == pytest.approx(1.5 / 6)
    assert one.days_between_orders == 5.0 and one.active_order_dow_count == 3
    assert one.weekend_order_ratio == pytest.approx(2 / 3) and one.evening_order_ratio == pytest.approx(2 / 3)
    # A single order without items: zeros, and the order count as frequency.
    assert (two.avg_basket_size, two.reorder_ratio, two.unique_products) == (0.0, 0.0, 0)
    assert (two.stddev_days_between_orders, two.order_frequency_30d, two.will_reorder) == (0.0, 1.0, 0)
    # A product outside the catalogue counts as an item, not as breadth.
    assert (three.unique_products, three.observed_basket_orders, three.will_reorder) == (0, 1, 1)


def test_churn_boundaries_are_exact(spark):
    features = spark.createDataFrame([
        (1, 2, 1.0, 0.5, 9, 20.0), (2, 9, 1.0, 0.1, 9, 1.0), (3, 1, 1.0, None, 9, None),
    ], "user_id long, total_orders long, avg_basket_size double, reorder_ratio double, unique_products long, "
       "days_between_orders double")
    churn = rows_by(marts.churn_probability(features), "user_id")
    assert churn[1].churn_probability == Decimal("0.70") and churn[1].churn_risk_segment == "high"
    # 0.50 - 0.10 + 0.20 - 0.05 - 0.05
    assert churn[2].churn_probability == Decimal("0.50") and churn[2].churn_risk_segment == "medium"
    # Missing inputs take the second value: 0.50 + 0.20 - 0.15 - 0.05 - 0.05
    assert churn[3].churn_probability == Decimal("0.45")


def test_lifetime_value_never_expects_less_than_one_order(spark):
    features = spark.createDataFrame(
        [(1, 1, 10.0, 0.0, 1, 30.0)],
        "user_id long, total_orders long, avg_basket_size double, reorder_ratio double, unique_products long, "
        "days_between_orders double",
    )
    value = marts.lifetime_value(features).first()
    assert value.predicted_future_value_proxy == 10.0 and value.customer_lifetime_value_proxy == 20.0


def test_training_rows_use_only_the_past(shop):
    facts = marts.fct_orders(shop[0], shop[1])
    rows = rows_by(training_dataset(facts, shop[1], shop[2]), "order_id")
    assert set(rows) == {2, 3, 6}
    second, third = rows[2], rows[3]
    assert (second.total_orders, second.unique_products, second.will_reorder) == (1, 2, 1)
    assert (second.customer_tenure_days, second.days_since_last_order) == (0.0, 10.0)
    # Order 3 falls on the day of order 2: the same day is not in the window, day 0 is.
    assert (third.order_frequency_30d, third.total_orders, third.days_since_last_order) == (1, 2, 0.0)
    assert third.reorder_ratio == pytest.approx(1 / 3) and third.dairy_eggs_item_ratio == pytest.approx(1 / 3)
    assert rows[6].order_frequency_30d == 0


def test_lines_are_dealt_before_they_are_grouped(shop):
    """No task combines whole splits of lines, or as many as adaptive execution merges, in memory."""
    facts = marts.fct_orders(shop[0], shop[1])
    met = first_meetings(facts, shop[1], shop[2])
    by_order = order_categories(shop[1], shop[2], [("dairy", "department", "dairy eggs")])
    for made, keys in ((met, "user_id#\\d+L?, product_id#\\d+L?"), (by_order, "order_id#\\d+L?")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"Exchange hashpartitioning\({keys}, \d+\), REPARTITION_BY_NUM", plan)
    totals = met.agg(*[F.sum(f"new_{kind}") for kind in ("product", "department", "aisle")]).first()
    known = shop[1].join(shop[2], "product_id").join(facts, "order_id")
    assert [*totals] == [known.select("user_id", c).distinct().count() for c in ("product_id", "department", "aisle")]


def test_lines_are_dealt_before_they_meet_their_orders(shop):
    """No task sorts as many lines for the join with their orders as adaptive execution merges."""
    met = first_meetings(marts.fct_orders(shop[0], shop[1]), shop[1], shop[2])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(order_id#\d+L?, \d+\), REPARTITION_BY_NUM", plan)


def test_expanded_first_meetings_are_dealt(shop):
    """The three rows of every first meeting are grouped where they are dealt, not before the shuffle."""
    met = first_meetings(marts.fct_orders(shop[0], shop[1]), shop[1], shop[2])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(user_id#\d+L?, kind#\d+, value#\d+, \d+\), REPARTITION_BY_NUM", plan)


def test_lines_are_dealt_before_orders_are_totalled(spark):
    """Lines of an order lie far apart in their file: no task combines a whole split of them in memory."""
    shop = Warehouse(spark, "/root/testdata/sf0.001")
    plan = shop.dealt_facts._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(order_id#\d+L?, \d+\), REPARTITION_BY_NUM", plan)
    rows = shop.dealt_facts.drop(RANGE)
    assert rows.exceptAll(shop.fct_orders).count() == 0 and rows.count() == shop.raw("orders").count()


def test_row_limit_keeps_lowest_users(shop):
    facts = marts.fct_orders(shop[0], shop[1])
    limited = training_dataset(facts, shop[1], shop[2], row_limit=2)
    assert [r.order_id for r in limited.collect()] == [2, 3]


def test_surrogate_key_is_null_with_a_missing_part(spark):
    raw = spark.createDataFrame([(1, None, 1, 0), (1, 2, 1, 0)], LINES)
    keys = [r.order_product_id for r in staging.stg_order_products(raw).collect()]
    assert keys == [None, "1-2"]


def test_spend_averages_differ_at_zero_orders(spark):
    df = spark.createDataFrame([(1, 300.0, 0), (2, 1000.0, 4)], "id int, total_spend double, order_count int")
    assert [r.average_order_value for r in insights.spend_intelligence(df).orderBy("id").collect()] == [None, 250.0]
    floored = insights.with_average_order_value(df).orderBy("id").collect()
    assert [r.average_order_value for r in floored] == [300.0, 250.0]
    assert "average_order_value" not in insights.with_average_order_value(df.drop("order_count")).columns


def test_missing_columns_become_typed_nulls(spark):
    df = insights.select_or_null(spark.range(1).select(F.col("id").alias("user_id")))
    assert df.columns == list(FEATURE_STORE_COLUMNS)
    assert df.schema["avg_basket_size"].dataType.simpleString() == "double"
    assert df.select(seg.behaviour_segment()).first()[0] == "limited_basket_detail"


def test_quality_checks_and_gate(spark, shop):
    lines = spark.createDataFrame([(1, 10, 1, 0), (1, 10, 2, 0), (None, 10, 1, 0), (2, 99, 1, 0)], LINES)
    checks = dq.raw_checks(shop[0], shop[2], lines)
    failed = {r.check_name: r.invalid_count for r in checks.where("invalid_count > 0").collect()}
    assert failed == {"order_id_not_null": 1, "order_product_unique": 1, "product_id_valid": 1}
    with pytest.raises(dq.QualityError, match="raw_order_products.product_id_valid"):
        dq.quality_gate(checks)
    good = dq.raw_checks(shop[0], shop[2], shop[1].where("product_id <> 99 and order_id <> 3"))
    assert dq.quality_gate(good).count() == 8
    summary = dq.quality_summary(dq.quality_report(checks)).first()
    assert (summary.data_quality_status, summary.data_quality_detail) == ("failed", "3 failed checks out of 8")
    assert dq.unavailable_summary(spark, "no access").first().data_quality_failures == 1


def test_incremental_runs_equal_a_full_build(spark, shop, tmp_path):
    orders, lines, _ = shop
    fact = incremental.FactTable(spark, str(tmp_path / "fct"), ids_per_range=2)
    assert fact.append_new(orders.where("order_id <= 3"), lines) == 0
    assert fact.append_new(orders, lines) == 3
    assert fact.append_new(orders, lines) == 6
    full = marts.fct_orders(orders, lines)
    stored = fact.read().select(*full.columns)
    assert stored.exceptAll(full).count() == 0 and stored.count() == 6


def test_a_changed_old_order_rewrites_its_range_alone(spark, shop, tmp_path):
    orders, lines, _ = shop
    fact = incremental.FactTable(spark, str(tmp_path / "fct"), ids_per_range=2)
    fact.merge(marts.fct_orders(orders, lines).withColumn("note", F.lit("old")))
    before = {part["range"]: part["folder"] for part in fact.table.manifest()["parts"]}
    assert sorted(before) == [0, 1, 2, 3] and fact.mark() == 6
    late = lines.unionByName(spark.createDataFrame([(4, 10, 1, 1)], LINES))
    assert fact.reprocess(orders, late, spark.createDataFrame([Row(order_id=4)])) == [2]
    after = {part["range"]: part["folder"] for part in fact.table.manifest()["parts"]}
    assert [r for r in before if before[r] != after[r]] == [2]
    fixed = rows_by(fact.read(), "order_id")
    assert len(fixed) == 6 and fixed[4].item_count == 1 and fixed[4].note is None and fixed[1].note == fixed[5].note == "old"
    assert fact.merge(marts.fct_orders(orders, lines).limit(0)) == []


def test_histogram_has_at_most_18_round_bins(spark):
    df = spark.range(1, 101).select(F.col("id").alias("total_orders"))
    starts = sorted(r.bin_start for r in insights.histogram(df).collect())
    assert starts == [10.0 * i for i in range(11)]


def test_selections(spark):
    cohorts = spark.createDataFrame(
        [(10, 2, 0.62), (9, 3, 0.41)], "cohort_order_number int, cohort_period int, retention_rate double"
    )
    weakest = insights.weakest_retention(cohorts).first()
    assert (weakest.cohort_order_number, weakest.lowest_rate, weakest.latest_rate) == (9, 0.41, 0.62)
    top = spark.createDataFrame(
        [(1, "Banana", 1000, 0.70), (2, "Organic Milk", 600, 0.90)],
        "product_id long, product_name string, order_line_count long, reorder_ratio double",
    )
    leader = insights.repeat_leader(top).first()
    assert (leader.volume_leader, leader.repeat_leader) == ("Banana", "Organic Milk")
    gaps = spark.createDataFrame(
        [("power", 5, 5.0), ("low_frequency", 7, 28.0)],
        "customer_segment string, users long, avg_days_between_orders double",
    )
    longest = insights.longest_gap_segment(gaps).first()
    assert (longest.customer_segment, longest.gap_text) == ("low_frequency", "28.00")


def test_packs_by_category(spark):
    from cartwright.plans.warehouse import Warehouse

    w = Warehouse(spark, "/root/testdata/sf0.001")
    assert set(insights.metric_pack(w, "retention")) == {"cohort_retention"}
    assert {"cohort_retention", "customer_behavior"} <= set(insights.metric_pack(w, "churn"))
    assert len(insights.metric_pack(w, "general")) == 10


def test_materialised_marts_give_the_same_churn(spark, tmp_path):
    from cartwright.plans.warehouse import Warehouse

    lazy = Warehouse(spark, "/root/testdata/sf0.001")
    stored = Warehouse(spark, "/root/testdata/sf0.001").materialise(str(tmp_path))
    assert stored.churn.exceptAll(lazy.churn).count() == 0


def test_stored_parts_change_no_feature(spark):
    from cartwright.plans.warehouse import Warehouse

    lazy, stored = (Warehouse(spark, "/root/testdata/sf0.001") for _ in range(2))
    stored.__dict__["small"] = False
    for name in ("feature_store", "training"):
        a, b = getattr(lazy, name), getattr(stored, name)
        rounded = [
            df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]) for df in (a, b)
        ]
        assert rounded[0].exceptAll(rounded[1]).count() == 0 and a.count() == b.count()
