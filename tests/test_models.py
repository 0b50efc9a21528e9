"""Metrics, training, monitoring and decisions on small fixtures."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cartwright.functions import text
from cartwright.operators import metrics as m
from cartwright.plans import decisions as dec, insights, model_tables as mt, monitoring as mon, training as tr
from cartwright.schemas import FEATURE_COLUMNS, RUN_HISTORY_SCHEMA, TRACKED_METRICS
from cartwright.sources import files

SCORED = "label int, score double"


def scored(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.3 + 0.5 * s), s) for s in (round(rng.random(), 2) for _ in range(n))]
    return rows, spark.createDataFrame(rows, SCORED)


def test_published_confusion_matrix(spark):
    counts = spark.createDataFrame([(12872, 304, 11650, 1416)], "tp long, fp long, fn long, tn long")
    r = counts.withColumns(m.rate_columns()).first()
    assert [round(x, 3) for x in (r.accuracy, r.precision, r.recall, r.balanced_accuracy, r.f1)] == [
        0.544, 0.977, 0.525, 0.674, 0.683
    ]


def test_rank_metrics_by_brute_force(spark):
    rows, df = scored(spark)
    got = m.rank_metrics(df).first()
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert got.roc_auc == pytest.approx(wins / len(pos) / len(neg))
    ap, before = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(s >= t for s in pos)
        ap += (tp / len(pos) - before) * tp / sum(s >= t for _, s in rows)
        before = tp / len(pos)
    assert got.average_precision == pytest.approx(ap)
    assert got.brier_score == pytest.approx(sum((s - y) ** 2 for y, s in rows) / len(rows))


@pytest.mark.parametrize("ranges", [1, 7])
def test_roc_points_drop_straight_runs(spark, ranges):
    rows, df = scored(spark)
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    points = []
    for t in sorted({s for _, s in rows}, reverse=True):
        points.append((sum(not y and s >= t for y, s in rows), sum(bool(y) and s >= t for y, s in rows), t))
    kept = [
        c for i, c in enumerate(points)
        if i in (0, len(points) - 1)
        or (points[i + 1][0] - c[0], points[i + 1][1] - c[1]) != (c[0] - points[i - 1][0], c[1] - points[i - 1][1])
    ]
    wanted = [(0.0, 0.0, None)] + [(f / n, t / p, s) for f, t, s in kept]
    got = [
        (r.false_positive_rate, r.true_positive_rate, r.threshold)
        for r in m.roc_points(df, ranges=ranges).orderBy("point").collect()
    ]
    assert got == wanted


def test_one_class_has_no_curve_and_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], SCORED)
    assert m.roc_points(df).count() == 0 and m.pr_points(df).count() == 0
    got = m.classification_metrics(df).first()
    assert got.roc_auc is None and got.average_precision is None and got.positive_rate == 1.0
    assert got.recommended_threshold == 0.05 and got.balanced_accuracy == 1.0
    classes = [r["class"] for r in m.classification_report(m.confusion_at_best(df)).collect()]
    assert classes == ["Reorder", "Macro Avg", "Weighted Avg"]


def test_curve_sample_keeps_both_ends(spark):
    points = spark.range(1000).select(F.col("id").alias("point"))
    got = sorted(r.point for r in m.curve_sample(points).collect())
    assert got == sorted({round(i * 999 / 199) for i in range(200)})
    assert m.curve_sample(spark.range(150).select(F.col("id").alias("point"))).count() == 150


def test_scaled_scores(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "decision double")
    assert sorted(r.score for r in m.scale_scores(df).collect()) == [0.0, 0.5, 1.0]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "decision double")
    assert [r.score for r in m.scale_scores(flat).collect()] == [0.5, 0.5]


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(200).select(F.col("id").alias("order_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    first = tr.stratified_split(df)
    sizes = {(r.label, r.is_test): r["count"] for r in first.groupBy("label", "is_test").count().collect()}
    assert sizes == {(0, True): 36, (0, False): 144, (1, True): 4, (1, False): 16}
    assert tr.stratified_split(df.repartition(7), ranges=9).exceptAll(first).count() == 0
    lonely = df.withColumn("label", (F.col("order_id") == 5).cast("int"))
    assert tr.stratified_split(lonely).where("is_test").count() == 40


def matrix_rows(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        x = [float(rng.randint(0, 20)) for _ in FEATURE_COLUMNS]
        rows.append((i, *x, int(x[0] + rng.random() * 8 > 13)))
    return spark.createDataFrame(rows, ["order_id", *FEATURE_COLUMNS, "will_reorder"])


def test_training_matrix_has_fixed_columns(spark):
    got = tr.training_matrix(matrix_rows(spark).drop("unique_aisles"))
    assert got.columns == ["order_id", *FEATURE_COLUMNS, "label"]
    assert got.where("unique_aisles <> 0").count() == 0


def test_training_validation(spark):
    df = matrix_rows(spark)
    tr.validate_training(df)
    for broken in (
        df.drop("will_reorder"),
        df.limit(0),
        df.where("will_reorder = 1"),
        df.withColumn("total_orders", F.lit("many")),
        df.select("order_id", "will_reorder"),
    ):
        with pytest.raises(ValueError):
            tr.validate_training(broken)


def test_rows_of_a_fit_lie_the_same_whatever_their_files(spark, monkeypatch):
    """Estimators sample by partition and place, so both follow from the rows alone, and partitions are even."""
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    df = spark.range(2000).select(F.col("id").alias("order_id"))

    def lie(rows):
        return [[r.order_id for r in part] for part in tr.fit_rows(rows, 2000).rdd.glom().collect()]

    first = lie(df.repartition(3))
    assert first == lie(df.orderBy(F.desc("order_id")).coalesce(1)) and len(first) == 20
    assert sorted(sum(first, [])) == list(range(2000)) and max(map(len, first)) < 160
    seen = []
    monkeypatch.setattr(tr, "candidate_models", lambda *a: {"m": type("P", (), {"fit": lambda self, t: seen.append(t.rdd.getNumPartitions())})()})
    monkeypatch.setattr(tr, "probability_scores", lambda model, test: test.withColumn("score", F.lit(0.5)))
    tr.fit_candidates(df.withColumn("label", (F.col("order_id") % 2).cast("int")))
    assert seen == [16]


def test_forest_keeps_where_rows_stand_and_stays_the_same(spark):
    """A level of the trees does not walk all rows down from the roots again; trees, nodes and splits are unchanged."""
    rows = tr.training_matrix(matrix_rows(spark)).withColumn("class_weight", F.lit(1.0) + F.col("label"))
    forest = tr.candidate_models(scale=0.05)["random_forest"]
    trees = forest.getStages()[-1]
    assert trees.getCacheNodeIds()
    kept = forest.fit(rows).stages[-1]
    trees.setCacheNodeIds(False)
    walked = forest.fit(rows).stages[-1]
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in walked.trees]
    assert kept.totalNumNodes > 4 * 10


def test_fit_score_save_and_load(spark, tmp_path):
    rows = tr.training_matrix(matrix_rows(spark))
    models, test_scores = tr.fit_candidates(rows, scale=0.05)
    best = tr.compare_models(test_scores).first()
    assert set(models) == {"random_forest", "logistic_regression", "gradient_boosting"} and best.roc_auc > 0.7
    for model in models.values():
        shares = tr.feature_importance(model, spark)
        assert shares.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    tr.save_model(models["logistic_regression"], str(tmp_path / "model"))
    loaded = tr.load_model(str(tmp_path / "model"))
    scores = tr.batch_score(loaded, rows)
    assert scores.where("reorder_probability between 0 and 1").count() == 240
    with pytest.raises(ValueError, match="unique_aisles"):
        tr.batch_score(loaded, rows.drop("unique_aisles"))


def test_stored_models_score_and_explain_as_tables(spark, tmp_path):
    rows = tr.training_matrix(matrix_rows(spark))
    models, _ = tr.fit_candidates(rows, scale=0.05)
    kinds = {"random_forest": mt.FOREST, "logistic_regression": mt.LINEAR, "gradient_boosting": mt.BOOSTED}
    for name, model in models.items():
        tr.save_model(model, f"{tmp_path}/{name}")
        kind, table = mt.stored_model(spark, f"{tmp_path}/{name}")
        assert kind == kinds[name]
        both = mt.score(kind, table, tr.probability_scores(model, rows).withColumnRenamed("score", "fitted"))
        worst = both.agg(F.max(F.abs(F.col("score") - F.col("fitted"))), F.count("score")).first()
        assert worst[0] < 1e-9 and worst[1] == 240
        shares = {r.feature: r.importance for r in mt.importance(kind, table).collect()}
        wanted = {r.feature: r.importance for r in tr.feature_importance(model, spark).collect()}
        assert shares == pytest.approx(wanted, abs=1e-9)


def test_range_contract(spark):
    df = spark.createDataFrame([(-1.0, 0.5), (3.0, 1.5)], "total_orders double, reorder_ratio double")
    assert {r.feature: r.violations for r in tr.range_violations(df).collect()} == {
        "total_orders": 1, "reorder_ratio": 1
    }


def history(spark, *runs):
    base = {n: 0.7 for n in TRACKED_METRICS} | {"top_feature": "total_orders", "top_feature_importance": 0.5}
    rows = [
        base | {"run_timestamp": datetime(2024, 1, i + 1), "selected_model": "gb", "train_rows": 80, "test_rows": 20,
                "threshold": 0.95} | run
        for i, run in enumerate(runs)
    ]
    names = ["run_timestamp", "selected_model", "train_rows", "test_rows", "threshold", "top_feature",
             "top_feature_importance", *TRACKED_METRICS]
    types = {"run_timestamp": "timestamp", "selected_model": "string", "train_rows": "long", "test_rows": "long",
             "top_feature": "string"}
    return spark.createDataFrame(
        [tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {types.get(n, 'double')}" for n in names)
    )


def test_drift_status_over_a_history(spark):
    runs = history(
        spark,
        {"balanced_accuracy": 0.75},
        {"balanced_accuracy": 0.66},
        {"balanced_accuracy": 0.66, "top_feature_importance": 0.62},
        {"balanced_accuracy": 0.66, "top_feature": "reorder_ratio", "top_feature_importance": 0.62},
        {"balanced_accuracy": 0.66, "top_feature": "reorder_ratio", "top_feature_importance": 0.62,
         "brier_score": 0.74, "roc_auc": None},
        {"balanced_accuracy": 0.70, "top_feature": "reorder_ratio", "top_feature_importance": 0.62,
         "brier_score": 0.74},
    )
    status = [r.status for r in mon.drift_status(runs).orderBy("run_timestamp").collect()]
    assert status == ["baseline", "attention", "attention", "attention", "attention", "stable"]
    found = [(r.metric, r.severity) for r in mon.all_findings(runs).orderBy("run_timestamp").collect()]
    assert found == [
        ("balanced_accuracy", "high"), ("top_feature_importance", "medium"), ("top_feature", "medium"),
        ("brier_score", "medium"),
    ]
    text_of = mon.drift_findings(runs).orderBy("run_timestamp").first().description
    assert text_of == "balanced_accuracy decreased by 0.090 compared with the previous run."


def test_run_records_are_appended_and_summarised(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert files.read_runs(spark, path).count() == 0
    records = mon.run_records(history(spark, {"roc_auc": 0.76}, {"roc_auc": 0.71, "f1": float("nan")}))
    assert len(records.columns) == len(RUN_HISTORY_SCHEMA) == 26
    files.append_runs(records.limit(1), path)
    files.append_runs(records.orderBy(F.desc("run_timestamp")).limit(1), path)
    stored = files.read_runs(spark, path)
    payload = json.loads(stored.collect()[1]["metrics"])
    assert payload["f1"] is None and payload["roc_auc"] == 0.71
    report = json.loads(stored.collect()[1]["drift_report"])
    assert sorted(report) == sorted((
        "status", "summary", "current_run_timestamp", "previous_run_timestamp", "selected_model", "findings", "tracked_metrics",
        "top_feature", "top_feature_importance",
    ))
    assert report["tracked_metrics"]["roc_auc"]["delta"] == pytest.approx(-0.05) and report["findings"][0]["metric"] == "roc_auc"
    first_report = json.loads(stored.collect()[0]["drift_report"])
    assert (first_report["findings"], first_report["tracked_metrics"], first_report["previous_run_timestamp"]) == ([], {}, None)
    summary = mon.drift_summary(stored).first()
    assert (summary.run_count, summary.drift_status) == (2, "attention")
    assert summary.roc_auc_delta == pytest.approx(-0.05)
    assert {f["metric"] for f in json.loads(summary.drift_findings_json)} == {"roc_auc"}
    bare = stored.limit(1).withColumn("drift_report", F.lit(None).cast("string"))
    alone = mon.drift_summary(bare).first()
    assert (alone.drift_status, alone.drift_summary) == ("baseline", "No drift report saved for the latest run.")


def entities(spark, schema, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "entity int, " + schema)


def test_anomalies_of_one_entity(spark):
    df = entities(spark, "reorder_rate double, churn_rate double, days_between_orders double", (0.22, 0.72, 28.0))
    found = {r.metric: r.severity for r in dec.detect_anomalies(df, "entity").collect()}
    assert found == {"reorder_rate": "high", "churn_rate": "critical", "days_between_orders": "high"}


def test_quality_comes_first(spark):
    df = entities(spark, "churn_rate double, data_quality_failures int, api_health string", (0.9, 2, "ok"))
    first = dec.build_decisions(df, "entity").orderBy("place").first()
    assert (first.decision_type, first.priority, first.metric) == ("alert", "critical", "data_quality_failures")


def test_retention_decision_and_french(spark):
    df = entities(spark, "reorder_rate double, churn_rate double, days_between_orders double", (0.20, 0.60, 25.0))
    first = dec.build_decisions(df, "entity", "fr").first()
    assert (first.priority, first.title) == ("high", "Lancer une intervention de retention")
    assert first.evidence["churn_rate"] == "0.6"
    sentence = dec.decision_explanations(df, "entity", "fr").first().explanation
    assert "elevee" in sentence and "3 signal(aux)" in sentence


def test_default_decision_and_text_inputs(spark):
    df = entities(
        spark, "reorder_rate string, churn_rate string, avg_churn_probability string, revenue_delta string",
        ("45%", "", "10%", "-5%"), ("1,000", "0.2", "90%", "-20%"), (None, None, "55%", "n/a"),
    )
    got = {(r.entity, r.metric, r.priority) for r in dec.build_decisions(df, "entity").collect()}
    assert got == {(0, "overall_health", "low"), (1, "revenue_delta", "high"), (2, "retention_risk", "high")}


def test_zero_falls_through_and_supplied_signal_is_overridden(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.75, [("churn_rate", "0.9", "low", "given")])],
        "entity int, churn_rate double, avg_churn_probability double, "
        "anomalies array<struct<metric:string,value:string,severity:string,description:string>>",
    )
    assert dec.build_decisions(df, "entity").first().priority == "critical"
    assert [r.description for r in dec.detect_anomalies(df, "entity").collect()][0] == "given"
    counts = dec.decision_counts(df, "entity").first()
    assert (counts.anomalies, counts.alerts, counts.recommendations) == (2, 0, 1)


def test_exact_distinct_counts_ids_once(spark):
    rows = [(1, 1), (1, 1), (1, 2), (40_000, 1), (40_000, None), (None, 3), (2**40, 5)]
    got = insights.exact_distinct(spark.createDataFrame(rows, "order_id long, product_id long")).first()
    assert (got.orders, got.products, got.pairs) == (3, 4, 4)
    assert insights.exact_distinct(spark.createDataFrame([], "order_id long, product_id long")).first() == (0, 0, 0)
    plan = insights.exact_distinct(spark.createDataFrame(rows, "order_id long, product_id long"))._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_metric_text(spark):
    values = [" 1,234 ", "12%", "abc%", "n/a", None, "1d", "-0.5", "1e3", ".5", "%", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select(
        "i", text.parse_metric(F.col("v")).alias("a"), text.parse_displayed_metric(F.col("v")).alias("b")
    ).orderBy("i").collect()
    assert [r.a for r in df] == [1234.0, 0.12, 0.0, 0.0, 0.0, 0.0, -0.5, 1000.0, 0.5, 0.0, 0.0]
    assert [r.b for r in df] == [1234.0, 12.0, None, None, None, None, -0.5, 1000.0, 0.5, None, None]


def test_question_categories_first_match_wins(spark):
    asked = ["Why is CHURN up in each cohort?", "rétention par client", "Top product?", "commande", "hello"]
    df = spark.createDataFrame([(q,) for q in asked], "q string").select(text.question_category(F.col("q")))
    assert [r[0] for r in df.collect()] == ["churn", "retention", "top_products", "customer_behavior", "general"]


def test_two_training_runs_leave_a_history(spark, tmp_path):
    from cartwright.plans.training_run import train_and_record

    rows = matrix_rows(spark)
    first = train_and_record(rows, str(tmp_path), scale=0.03, now=datetime(2024, 5, 1))
    assert first["comparison"].count() == 3 and first["importance"].count() == len(FEATURE_COLUMNS)
    second = train_and_record(rows, str(tmp_path), scale=0.03, now=datetime(2024, 5, 2))
    record = second["record"].first()
    artifact = spark.read.json(str(tmp_path / "metrics")).first()
    assert len(artifact.threshold_analysis) == 19 and len(artifact.model_comparison) == 3
    assert artifact.model_comparison[0].model_name == artifact.selected_model == record.selected_model
    assert sum(map(sum, artifact.confusion_matrix)) == artifact.rows and 2 < len(artifact.roc_curve) <= 200
    assert json.loads(record.metrics)["tp"] == artifact.tp and len(json.loads(record.feature_importance)) == len(FEATURE_COLUMNS)
    assert [x["model_name"] for x in json.loads(record.model_comparison)] == [x.model_name for x in artifact.model_comparison]
    assert json.loads(record.drift_report)["status"] == "stable" and record.train_rows + record.test_rows == 240
    runs = files.read_runs(spark, str(tmp_path / "runs"))
    assert [json.loads(r.drift_report)["status"] for r in runs.collect()] == ["baseline", "stable"]
    assert mon.drift_summary(runs).first().run_count == 2
    scores = tr.batch_score(tr.load_model(str(tmp_path / "model")), tr.training_matrix(rows))
    assert scores.count() == 240


def test_user_level_table_can_be_trained_on(spark):
    rows = tr.training_matrix(matrix_rows(spark).withColumnRenamed("order_id", "user_id").drop("days_since_last_order"))
    _, scores = tr.fit_candidates(rows, names=("logistic_regression",), key="user_id")
    assert scores.count() in (48, 49)
