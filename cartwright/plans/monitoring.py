"""Run history, drift findings and status. One row per training run: a small control table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import col

from cartwright.operators import metrics as m
from cartwright.schemas import FEATURE_COLUMNS, RUN_HISTORY_SCHEMA, TRACKED_METRICS

METRIC_DROP = 0.03
FEATURE_SHIFT = 0.10
HIGH_DRIFT = 0.08
LOWER_IS_BETTER = ("brier_score",)
COMPARED = (
    "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "recommended_threshold",
    "positive_prediction_rate", "average_precision", "brier_score",
)


# Sentences of findings and reports.
FEATURE_CHANGED = "The most influential feature changed compared with the previous run."
IMPORTANCE_MOVED = "The leading feature importance changed materially compared with the previous run."
BASELINE = "First tracked training run saved as the monitoring baseline."
STABLE = "Model monitoring is stable against the previous training run."
SIGNALS = "Model monitoring found %d signal(s) requiring review."
NO_REPORT = "No drift report saved for the latest run."


def json_safe(value: Column, kind: T.DataType) -> Column:
    """``value`` with NULL for numbers that JSON cannot hold, at any depth of structs, arrays and maps."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, kind.valueType))
    return value


def as_json(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as JSON text, unknown values as null."""
    return df.withColumns({n: F.to_json(json_safe(col(n), df.schema[n].dataType), {"ignoreNullFields": "false"}) for n in names})


def from_report(report: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(report), path, kind)


def class_gap_importance(rows: DataFrame, by: list[str], label: str = "will_reorder") -> DataFrame:
    """Per group and feature, the relative gap between the class means as a share of all gaps."""
    gaps = [
        F.coalesce(
            F.try_divide(
                F.abs(F.avg(F.when(col(label) == 1, col(c))) - F.avg(F.when(col(label) == 0, col(c)))),
                F.abs(F.avg(c)),
            ),
            F.lit(0.0),
        ).alias(c)
        for c in FEATURE_COLUMNS
    ]
    wide = rows.groupBy(*by).agg(*gaps)
    total = sum((col(c) for c in FEATURE_COLUMNS[1:]), col(FEATURE_COLUMNS[0]))
    shares = wide.select(*by, *[F.coalesce(F.try_divide(col(c), total), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS])
    return shares.unpivot(by, FEATURE_COLUMNS, "feature", "importance")


def top_feature(importance: DataFrame, by: list[str]) -> DataFrame:
    rank = F.struct(-col("importance"), col("feature"))
    known = importance.where(col("importance").isNotNull())
    return known.groupBy(*by).agg(
        F.min_by("feature", rank).alias("top_feature"), F.max("importance").alias("top_feature_importance")
    )


def evaluation_records(metrics: DataFrame, tops: DataFrame, by: str = "run_timestamp") -> DataFrame:
    """One record per run: seven facts and the tracked metrics of the selected model."""
    rank = F.struct(
        col("roc_auc").isNull().cast("int"), -F.coalesce("roc_auc", F.lit(0.0)), -F.coalesce("f1", F.lit(0.0)),
        col("model_name"),
    )
    wanted = ["model_name", "recommended_threshold", "rows", *TRACKED_METRICS]
    best = metrics.groupBy(by).agg(F.min_by(F.struct(*wanted), rank).alias("b"))
    everything = best.agg(F.sum("b.rows").alias("n")).scalar()
    return best.join(tops, by, "left").select(
        by,
        F.coalesce(col("b.model_name"), F.lit("unknown")).alias("selected_model"),
        (everything - col("b.rows")).cast("bigint").alias("train_rows"),
        col("b.rows").cast("bigint").alias("test_rows"),
        col("b.recommended_threshold").alias("threshold"),
        "top_feature",
        "top_feature_importance",
        *[col(f"b.{name}").alias(name) for name in TRACKED_METRICS],
    )


def metric_changes(history: DataFrame) -> DataFrame:
    """Per run and metric, the value of the previous run and the change; unknown pairs are left out."""
    long = history.unpivot(["run_timestamp"], list(TRACKED_METRICS), "metric", "current_value")
    in_time = Window.partitionBy("metric").orderBy("run_timestamp")
    return (
        long.withColumn("previous_value", F.lag("current_value").over(in_time))
        .where(col("previous_value").isNotNull() & col("current_value").isNotNull())
        .withColumn("delta", col("current_value") - col("previous_value"))
    )


def drift_findings(history: DataFrame, drop: float = METRIC_DROP) -> DataFrame:
    """Metrics that got worse by more than ``drop`` from one run to the next."""
    delta = col("delta")
    worse = F.when(col("metric").isin(*LOWER_IS_BETTER), delta > drop).otherwise(delta < -drop)
    return metric_changes(history).where(worse).select(
        "run_timestamp",
        F.lit("metric_drift").alias("type"),
        "metric",
        col("previous_value").cast("string").alias("previous_value"),
        col("current_value").cast("string").alias("current_value"),
        "delta",
        F.when(F.abs(delta) >= HIGH_DRIFT, "high").otherwise("medium").alias("severity"),
        F.format_string(
            "%s %s by %.3f compared with the previous run.",
            "metric", F.when(delta > 0, "increased").otherwise("decreased"), F.abs(delta),
        ).alias("description"),
    )


def feature_drift(history: DataFrame, shift: float = FEATURE_SHIFT) -> DataFrame:
    """Runs whose top feature changed, or whose top importance moved by at least ``shift``."""
    before, now = col("previous_top_feature"), col("top_feature")
    weight_before, weight = col("previous_top_feature_importance"), col("top_feature_importance")
    both = ("top_feature", "top_feature_importance")
    pairs = _in_time(history.select("run_timestamp", *both), *both    ).withColumn("changed", F.coalesce((before != "") & (now != "") & (before != now), F.lit(False)))
    moved = F.abs(weight - weight_before) >= shift
    return pairs.where(col("changed") | F.coalesce(moved, F.lit(False))).select(
        "run_timestamp",
        F.lit("feature_drift").alias("type"),
        F.when(col("changed"), "top_feature").otherwise("top_feature_importance").alias("metric"),
        F.when(col("changed"), before).otherwise(weight_before.cast("string")).alias("previous_value"),
        F.when(col("changed"), now).otherwise(weight.cast("string")).alias("current_value"),
        (weight - weight_before).alias("delta"),
        F.lit("medium").alias("severity"),
        F.when(col("changed"), FEATURE_CHANGED)
        .otherwise(IMPORTANCE_MOVED)
        .alias("description"),
    )


def all_findings(history: DataFrame) -> DataFrame:
    return drift_findings(history).unionByName(feature_drift(history))


def _in_time(history: DataFrame, *columns: str) -> DataFrame:
    """Each run with columns of the run before it, by one value per run: the timestamps in order."""
    known = F.array_sort(F.collect_set("run_timestamp"))
    order = history.agg(known.alias("v")).scalar()
    paired = history.withColumn("_order", order)
    place = F.array_position("_order", col("run_timestamp")).cast("int")
    before = F.when(place > 1, F.try_element_at("_order", place - 1))
    paired = paired.withColumn("_before", before).drop("_order")
    earlier = history.select(col("run_timestamp").alias("_before"), *[col(c).alias(f"previous_{c}") for c in columns])
    return paired.join(earlier.dropDuplicates(["_before"]), "_before", "left").withColumnRenamed("_before", "previous_run_timestamp")


def drift_status(history: DataFrame) -> DataFrame:
    """The drift report of every run: baseline for the first, then attention or stable, with the findings, all
    tracked metrics beside the previous run's, and the leading feature."""
    findings = all_findings(history).groupBy("run_timestamp").agg(
        F.sort_array(
            F.collect_list(
                F.struct("metric", "type", "severity", "delta", "previous_value", "current_value", "description")
            )
        ).alias("findings")
    )
    tracked = metric_changes(history).groupBy("run_timestamp").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(
            "metric", F.struct(col("previous_value").alias("previous"), col("current_value").alias("current"), "delta")
        )))).alias("tracked_metrics")
    )
    runs = _in_time(history.select("run_timestamp", "selected_model", "top_feature", "top_feature_importance"))
    first = col("previous_run_timestamp").isNull()
    reports = runs.join(findings, "run_timestamp", "left").join(tracked, "run_timestamp", "left")
    found = F.coalesce(F.size("findings"), F.lit(0))
    n = F.when(col("findings").isNull(), 0).otherwise(found).cast("bigint")
    return as_json(reports.select(
        "run_timestamp",
        "previous_run_timestamp",
        "selected_model",
        F.when(first, "baseline").when(n > 0, "attention").otherwise("stable").alias("status"),
        F.when(first, BASELINE).when(n > 0, F.format_string(SIGNALS, n)).otherwise(STABLE).alias("summary"),
        n.alias("findings"),
        F.coalesce("findings", F.from_json(F.lit("[]"), findings.schema["findings"].dataType)).alias("findings_json"),
        F.coalesce("tracked_metrics", F.from_json(F.lit("{}"), tracked.schema["tracked_metrics"].dataType)).alias("tracked_json"),
        "top_feature",
        "top_feature_importance",
    ), "findings_json", "tracked_json")


def run_payloads(metrics: DataFrame, importance: DataFrame, by: str = "run_timestamp") -> DataFrame:
    """Per run, as JSON: all metrics of the selected model, the importance of every feature, and all models compared."""
    names = [c for c in metrics.columns if c not in (by, "model_name")]
    compared = [c for c in COMPARED if c in metrics.columns]
    rank = F.struct(
        col("roc_auc").isNull().cast("int").alias("a"), (-F.coalesce("roc_auc", F.lit(0.0))).alias("b"),
        (-F.coalesce("f1", F.lit(0.0))).alias("c"), col("model_name").alias("d"),
    )
    models = metrics.groupBy(by).agg(
        F.min_by(F.struct("model_name", *names), rank).alias("metrics"),
        F.transform(
            F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.struct("model_name", *compared).alias("m")))), lambda x: x["m"]
        ).alias("model_comparison"),
    )
    shares = importance.groupBy(by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-col("importance")).alias("r"), "feature", "importance"))),
            lambda x: F.struct(x["feature"].alias("feature"), x["importance"].alias("importance")),
        ).alias("feature_importance")
    )
    return as_json(models.join(shares, by, "left"), "metrics", "model_comparison", "feature_importance")


def run_records(
    history: DataFrame,
    source_relation: str = "fct_orders",
    model_path: str | None = None,
    model_uri: str | None = None,
    payloads: DataFrame | None = None,
) -> DataFrame:
    """Evaluation records completed to the run-history schema: ids, payloads (those of ``run_payloads``, or
    what the record itself knows) and the whole drift report."""
    status = drift_status(history)
    report = F.struct(
        "status", "summary", col("run_timestamp").cast("string").alias("current_run_timestamp"),
        col("previous_run_timestamp").cast("string").alias("previous_run_timestamp"), "selected_model",
        F.try_parse_json("findings_json").alias("findings"), F.try_parse_json("tracked_json").alias("tracked_metrics"),
        "top_feature", json_safe(col("top_feature_importance"), T.DoubleType()).alias("top_feature_importance"),
    )
    reports = status.select("run_timestamp", F.to_json(report, {"ignoreNullFields": "false"}).alias("drift_report"))
    complete = history.join(reports, "run_timestamp", "left")
    if payloads is None:
        known = complete.withColumns({
            "metrics": F.struct(*sorted(TRACKED_METRICS)),
            "feature_importance": F.array(F.struct(col("top_feature").alias("feature"), col("top_feature_importance").alias("importance"))),
            "model_comparison": F.lit("[]"),
        })
        complete = as_json(known, "metrics", "feature_importance")
    else:
        complete = complete.join(payloads, "run_timestamp", "left")
    complete = complete.withColumns({
        "run_id": F.md5(F.concat_ws("|", F.lit(source_relation), col("run_timestamp").cast("string"))),
        "model_selection_metric": F.lit("roc_auc"),
        "source_relation": F.lit(source_relation),
        "model_artifact_path": F.lit(model_path),
        "model_artifact_uri": F.lit(model_uri),
        "created_at": F.current_timestamp(),
    })
    return complete.select(*[col(f.name).cast(f.dataType) for f in RUN_HISTORY_SCHEMA.fields])


def run_history(history: DataFrame) -> DataFrame:
    return history.select(
        "run_timestamp", "selected_model", "train_rows", "test_rows", "threshold", "accuracy",
        "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "brier_score",
        "top_feature", "top_feature_importance",
    ).orderBy("run_timestamp")


def recent_metrics(history: DataFrame, n: int = 12) -> DataFrame:
    """The last runs' main metrics as (run_timestamp, metric, value), unknown values left out."""
    recent = history.orderBy(F.desc("run_timestamp")).limit(n)
    names = ["roc_auc", "f1", "balanced_accuracy", "precision", "recall"]
    return recent.select("run_timestamp", *names).unpivot(["run_timestamp"], names, "metric", "value").dropna(
        subset=["run_timestamp", "value"]
    )


def drift_summary(history: DataFrame) -> DataFrame:
    """The latest run beside its predecessor. Two rows are enough, so the history is never sorted whole."""
    run_count = history.agg(F.count(F.lit(1)).alias("n")).scalar()
    latest_two = history.orderBy(F.desc("run_timestamp")).limit(2)
    in_time = Window.orderBy("run_timestamp")
    compared = ("run_id", "run_timestamp", "roc_auc", "balanced_accuracy", "brier_score", "top_feature",
                "top_feature_importance")
    paired = latest_two.withColumns({f"previous_{c}": F.lag(c).over(in_time) for c in compared}).withColumn(
        "recency", F.row_number().over(Window.orderBy(F.desc("run_timestamp")))
    )

    def with_delta(name: str) -> list[Column]:
        return [col(name), col(f"previous_{name}"), (col(name) - col(f"previous_{name}")).alias(f"{name}_delta")]

    report = col("drift_report")
    return paired.where(col("recency") == 1).select(
        run_count.alias("run_count"),
        col("run_id").alias("current_run_id"),
        col("run_timestamp").alias("current_run_timestamp"),
        "previous_run_id",
        "previous_run_timestamp",
        "selected_model",
        "model_selection_metric",
        "source_relation",
        "model_artifact_uri",
        F.coalesce(
            from_report(report, "$.status"), F.when(run_count <= 1, "baseline").otherwise("stable")
        ).alias("drift_status"),
        F.coalesce(
            from_report(report, "$.summary"), F.lit(NO_REPORT)
        ).alias("drift_summary"),
        F.to_json(F.try_variant_get(F.try_parse_json(report), "$.findings", "variant")).alias("drift_findings_json"),
        *with_delta("roc_auc"),
        *with_delta("balanced_accuracy"),
        *with_delta("brier_score"),
        "precision",
        "recall",
        "f1",
        "top_feature",
        "previous_top_feature",
        *with_delta("top_feature_importance"),
    )


def history_from_scores(scored: DataFrame, features: DataFrame) -> DataFrame:
    """Evaluation records of many runs at once. ``scored`` has (run_timestamp, model_name, label,
    score); ``features`` the feature rows of the same runs."""
    metrics = m.classification_metrics(scored, ["run_timestamp", "model_name"])
    tops = top_feature(class_gap_importance(features, ["run_timestamp"]), ["run_timestamp"])
    return evaluation_records(metrics, tops)


def payloads_from_scores(scored: DataFrame, features: DataFrame) -> DataFrame:
    """The payloads of the runs of ``history_from_scores``."""
    metrics = m.classification_metrics(scored, ["run_timestamp", "model_name"])
    return run_payloads(metrics, class_gap_importance(features, ["run_timestamp"]))
