"""Prefix scans over ranges against brute force: hot groups, a NULL group, crowded days and scores."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from cartwright.operators import metrics
from cartwright.operators.running import RANGE, scan, trailing_count
from cartwright.plans.history import order_history
from cartwright.sources.shop import number_orders

SKEWED = "id int, user int, number int, gap double, items int"


def skewed(n=600):
    rng = random.Random(7)
    rows, numbers = [], {}
    for i in range(n):
        user = 0 if rng.random() < 0.4 else None if rng.random() < 0.1 else rng.randint(1, 40)
        numbers[user] = numbers.get(user, 0) + 1
        rows.append((i, user, numbers[user], 1e9 + rng.randint(0, 9), rng.choice([None, 1, 2, 3])))
    return rows


@pytest.mark.parametrize("ranges", [1, 13, None])
def test_scan(spark, ranges):
    rows = skewed()
    out = scan(
        spark.createDataFrame(rows, SKEWED).repartition(5), ["user"], ["number"], {"items_before": F.col("items"), "n": F.lit(1)},
        {"gaps": F.col("gap")}, previous=["items", "id"], following=["items"], keep=["id"], ranges=ranges,
    )
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    for group in groups.values():
        for place, (i, _, _, _, _) in enumerate(group):
            r, past = got[i], group[:place]
            assert r.items_before == sum(x[4] or 0 for x in past) and r.n == place and r.is_first == (place == 0)
            assert (r.previous_items, r.previous_id) == ((past[-1][4], past[-1][0]) if past else (None, None))
            assert r.next_items == (group[place + 1][4] if place + 1 < len(group) else None)
            gaps = [x[3] for x in past]
            assert r.gaps.n == place
            assert r.gaps.m2 == pytest.approx(statistics.pvariance(gaps) * place if gaps else 0.0, rel=1e-6, abs=1e-4)


def test_ends_of_ranges_sort_only_the_ends_of_groups(spark):
    rows = spark.createDataFrame(skewed(), SKEWED)
    plan = scan(rows, ["user"], ["number"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter \(\(_row#\d+ = 1\) OR isnull\(_more#\d+\)\)", plan)


def test_a_scan_takes_over_the_ranges_of_an_earlier_one(spark):
    first = scan(spark.createDataFrame(skewed(), SKEWED), ["user"], ["number"], {"n": F.lit(1)}, ranges=9)
    second = scan(first.withColumn("odd", F.col("n") % 2), ["user"], ["number"], {"odd_before": F.col("odd")})
    assert second.where("odd_before <> floor(n / 2)").count() == 0 and second.select(RANGE).distinct().count() > 3


def test_scan_of_nothing(spark):
    assert scan(spark.createDataFrame([], SKEWED), ["user"], ["number"], {"n": F.lit(1)}, previous=["gap"], following=["gap"]).collect() == []


def test_ranges_are_even_where_scores_are_crowded(spark):
    """All but a few scores lie within a thousandth of the range, under one key."""
    scores = spark.range(200_000).select(
        F.lit(0).alias("key"), F.when(F.col("id") % 1000 == 0, F.rand(1)).otherwise(0.5 + F.rand(2) / 1000).alias("score")
    )
    dealt = scan(scores, ["key"], ["score"], {"n": F.lit(1)}, ranges=50)
    sizes = [r["count"] for r in dealt.groupBy(RANGE).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 3 * 200_000 / 50


@pytest.mark.parametrize("width", [31, 4096])
def test_trailing_count(spark, width):
    rng = random.Random(3)
    rows = []
    for user in (None, 1, 2):
        days = sorted({rng.randint(0, 400) + rng.choice([0.0, 0.5]) for _ in range(150 if user == 1 else 8)})
        rows += [(user, float(d), rng.randint(1, 4)) for d in days]
    out = trailing_count(spark.createDataFrame(rows, "user int, day double, n int"), ["user"], "day", "n", reach=30, width=width)
    wanted = {(u, d): sum(n for v, e, n in rows if v == u and d - 30 <= e <= d - 1) for u, d, _ in rows}
    assert {(r.user, r.day): r.trailing for r in out.collect()} == wanted


def test_numbering_does_not_depend_on_the_ranges(spark):
    from cartwright.plans.warehouse import Warehouse

    base = Warehouse(spark, "/root/testdata/sf0.001").order_base
    user = F.when(F.col("order_id") % 3 == 0, 0).when(F.col("order_id") % 3 == 1, F.col("user_id"))
    day = F.when(F.col("order_id") % 2 == 0, F.lit("1995-03-01").cast("date")).otherwise(F.col("order_date"))
    hot = base.withColumns({"user_id": user, "order_date": day})
    one, many = (number_orders(hot, n).drop(RANGE) for n in (1, 23))
    assert one.exceptAll(many).count() == 0 and many.count() == one.count()
    timelines = {}
    for r in hot.collect():
        timelines.setdefault(r.user_id, []).append((r.order_date, r.order_id))
    wanted = {}
    for timeline in timelines.values():
        before = None
        for place, (date, order_id) in enumerate(sorted(timeline), 1):
            wanted[order_id] = (place, None if before is None else float((date - before).days // 10))
            before = date
    assert {r.order_id: (r.order_number, r.days_since_prior_order) for r in many.collect()} == wanted


def test_history_does_not_depend_on_the_ranges(spark):
    from cartwright.plans.warehouse import Warehouse

    w = Warehouse(spark, "/root/testdata/sf0.001")
    one, many = (
        order_history(w.stored_facts.drop(RANGE), w.stg_order_products, w.stg_products, w.categories, ranges=n) for n in (1, 29)
    )
    rounded = [
        df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]) for df in (one, many)
    ]
    assert rounded[0].exceptAll(rounded[1]).count() == 0
    assert one.count() == many.count() == 1500


def test_curves_of_groups_do_not_depend_on_the_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    for made in (metrics.roc_points, metrics.score_curve):
        one, many = (made(df, ["model"], ranges=n) for n in (1, 11))
        assert RANGE not in one.columns
        assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 and one.count() > 100


def test_history_keeps_orders_without_user_and_skips_unknown_weekdays(spark):
    facts = spark.createDataFrame(
        [  # a NULL user, a NULL weekday and hour, two orders on one day, a fractional gap
            (1, 7, "prior", 1, 4, 10, None, 2, 0),
            (2, 7, "prior", 2, None, None, 0.0, 1, 1),
            (3, 7, "train", 3, 2, 8, 2.5, 3, 1),
            (4, None, "prior", 1, 1, 9, None, 1, 0),
            (5, None, "train", 2, 5, 20, 5.0, 1, 1),
        ],
        "order_id int, user_id int, eval_set string, order_number int, order_dow int, order_hour_of_day int, "
        "days_since_prior_order double, item_count long, reordered_item_count long",
    )
    rows = {r.order_id: r for r in order_history(facts).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert (rows[3].avg_order_dow, rows[3].avg_order_hour_of_day) == (4.0, 10.0)
    assert [rows[i].order_frequency_30d for i in (1, 2, 3, 4, 5)] == [0, 0, 2, 0, 1]
    assert [rows[i].total_orders for i in (1, 2, 3, 4, 5)] == [0, 1, 2, 0, 1]
