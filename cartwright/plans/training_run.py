"""One training run from rows to stored model, metrics, importance and run history."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import col

from cartwright.operators import metrics as m
from cartwright.plans import monitoring as mon, training as tr
from cartwright.schemas import TRACKED_METRICS
from cartwright.session import settle
from cartwright.sources import files


def metrics_artifact(scored: DataFrame, chosen: DataFrame, comparison: DataFrame, advice: DataFrame) -> DataFrame:
    """One row with everything known of the selected model: metrics, confusion matrix, report, the threshold table,
    both curves at no more than ``CURVE_POINTS`` points, all models compared, and the advice."""

    def rows(df: DataFrame, *first: str) -> Column:
        names = [*first, *[c for c in df.columns if c not in first]]
        return df.agg(F.sort_array(F.collect_list(F.struct(*names)))).scalar()

    report = m.classification_report(m.confusion_at_best(scored))
    ranked = comparison.select("*", (-F.coalesce("roc_auc", F.lit(0.0))).alias("_rank"), (-F.coalesce("f1", F.lit(0.0))).alias("_next"))
    return chosen.withColumns({
        "selected_model": col("model_name"),
        "model_selection_metric": F.lit("roc_auc"),
        "threshold_selection_metric": F.lit("balanced_accuracy"),
        "confusion_matrix": F.array(F.array("tn", "fp"), F.array("fn", "tp")),
        "classification_report": rows(report, "class"),
        "threshold_analysis": rows(m.threshold_analysis(scored), "threshold"),
        "roc_curve": rows(m.curve_sample(m.roc_points(scored)), "point"),
        "precision_recall_curve": rows(m.curve_sample(m.pr_points(scored)), "point"),
        "model_recommendations": rows(advice, "rule_no"),
    }).withColumn("_compared", rows(ranked, "_rank", "_next", "model_name")).withColumn(
        "model_comparison", F.transform("_compared", lambda x: x.dropFields("_rank", "_next"))
    ).drop("_compared")


def train_and_record(
    rows: DataFrame,
    folder: str,
    source_relation: str = "fct_orders",
    key: str = "order_id",
    scale: float = 1.0,
    now: datetime | None = None,
) -> dict[str, DataFrame]:
    """Fit the candidates, keep the best and write everything under ``folder``.

    The driver sees the name of the best model, its fitted form and one row of metrics; rows stay
    on the executors. Returns the comparison, the importance, the advice and the stored record.
    """
    spark = rows.sparkSession
    tr.validate_training(rows)
    matrix = settle(tr.training_matrix(rows))
    models, scored = tr.fit_candidates(matrix, scale=scale, key=key)
    scored = settle(scored)
    metrics = settle(m.classification_metrics(scored, ["model_name"]))
    comparison = m.model_comparison(metrics)
    best = comparison.first().model_name

    tr.save_model(models[best], f"{folder}/model")
    importance = tr.feature_importance(models[best], spark)
    # The positive rate is that of the whole set, not of its test part.
    whole = matrix.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"))
    chosen = metrics.where(col("model_name") == best).withColumn(
        "positive_rate", whole.select("rate").scalar()
    )
    advice = tr.model_recommendations(chosen, importance)
    own = scored.where(col("model_name") == best)
    files.write_metrics_json(metrics_artifact(own, chosen, comparison, advice), f"{folder}/metrics")
    files.write_importance_csv(importance, f"{folder}/importance")

    stamp = now or datetime.now(timezone.utc)
    top = importance.agg(
        F.max_by("feature", "importance").alias("top_feature"), F.max("importance").alias("top_feature_importance")
    )
    record = chosen.select(
        F.lit(stamp).alias("run_timestamp"),
        col("model_name").alias("selected_model"),
        (whole.select("n").scalar() - col("rows")).cast("bigint").alias("train_rows"),
        col("rows").cast("bigint").alias("test_rows"),
        col("recommended_threshold").alias("threshold"),
        top.select("top_feature").scalar().alias("top_feature"),
        top.select("top_feature_importance").scalar().alias("top_feature_importance"),
        *TRACKED_METRICS,
    )
    history_path = f"{folder}/runs"
    before = files.read_runs(spark, history_path).select(*record.columns)
    known = settle(before.unionByName(record))
    payloads = mon.run_payloads(
        metrics.withColumn("run_timestamp", F.lit(stamp)), importance.withColumn("run_timestamp", F.lit(stamp))
    )
    stored = mon.run_records(known, source_relation, f"{folder}/model", payloads=payloads).where(
        col("run_timestamp") == F.lit(stamp)
    )
    files.append_runs(stored, history_path)
    return {
        "comparison": comparison,
        "importance": importance,
        "recommendations": advice,
        "record": files.read_runs(spark, history_path).where(col("run_timestamp") == F.lit(stamp)),
    }
