"""Binary classification metrics as aggregations over (label, score) rows.

Every function takes optional grouping columns ``by``, so the runs of a whole history are
evaluated in one job. Rows are first combined per score or per threshold step.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import col

from cartwright.operators.running import scan
from cartwright.session import settle

# The decision thresholds 0.05, 0.10 ... 0.95.
THRESHOLDS = [round(step / 20, 2) for step in range(1, 20)]
CURVE_POINTS = 200
DEFAULT_THRESHOLD = 0.5


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def score_counts(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    return scored.groupBy(*by, "score").agg(
        F.count_if(col("label") == 1).alias("pos"), F.count_if(col("label") == 0).alias("neg")
    )


def rate_columns() -> dict[str, Column]:
    """Rates from tp, fp, fn and tn; a zero denominator gives 0."""
    tp, fp, fn, tn = (col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    classes = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return {
        "accuracy": _ratio(tp + tn, n),
        "precision": _ratio(tp, tp + fp),
        "recall": recall,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        # The mean recall of the classes that occur.
        "balanced_accuracy": _ratio(recall + specificity, classes),
        "specificity": specificity,
        "false_positive_rate": 1 - specificity,
        "positive_prediction_rate": _ratio(tp + fp, n),
    }


def threshold_counts(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Confusion counts per threshold. A row is reduced to the number of thresholds it passes, so
    only 20 partial rows per group and label are expanded to the 19 thresholds."""
    passed = reduce(add, [(col("score") >= t).cast("int") for t in THRESHOLDS])
    steps = scored.groupBy(*by, passed.alias("passed")).agg(
        F.count_if(col("label") == 1).alias("pos"), F.count_if(col("label") == 0).alias("neg")
    )
    number = col("number")
    expanded = steps.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(len(THRESHOLDS)))))
    predicted = col("passed") >= number
    return (
        expanded.groupBy(*by, "number")
        .agg(
            F.sum(F.when(predicted, col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(predicted, col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(predicted, 0).otherwise(col("pos"))).alias("fn"),
            F.sum(F.when(predicted, 0).otherwise(col("neg"))).alias("tn"),
        )
        .withColumn("threshold", F.round(number / 20, 2))
        .drop("number")
    )


def threshold_analysis(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    rates = rate_columns()
    wanted = (
        "precision", "recall", "f1", "balanced_accuracy", "specificity", "false_positive_rate",
        "positive_prediction_rate",
    )
    return threshold_counts(scored, by).select(*by, "threshold", *[rates[n].alias(n) for n in wanted])


def _threshold_rank() -> Column:
    return F.struct(
        col("balanced_accuracy"), col("f1"), -F.abs(col("positive_prediction_rate") - 0.5), -col("threshold")
    )


def recommended_threshold(analysis: DataFrame, by: list[str] = ()) -> DataFrame:
    """Best balanced accuracy, then F1, then a prediction rate near one half, then the lowest."""
    best = F.coalesce(F.max_by("threshold", _threshold_rank()), F.lit(DEFAULT_THRESHOLD))
    return analysis.groupBy(*by).agg(best.alias("recommended_threshold"))


def confusion_at_best(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per group, counts and rates at its recommended threshold."""
    rows = threshold_counts(scored, by).withColumns(rate_columns())
    kept = ["threshold", "tp", "fp", "fn", "tn", *rate_columns()]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*kept), _threshold_rank()).alias("best")).select(
        *by, *[col(f"best.{c}").alias(c) for c in kept]
    )


def confusion_rows(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    names = {"tn": "true_negatives", "fp": "false_positives", "fn": "false_negatives", "tp": "true_positives"}
    wide = counts.select(*by, *[col(c).alias(n) for c, n in names.items()])
    return wide.unpivot(list(by), list(names.values()), "cell", "rows")


def _falling_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts per score with ``falling``, which orders scores from the highest, unknown ones last."""
    return score_counts(scored, by).withColumn("falling", F.coalesce(-col("score"), F.lit(float("inf"))))


def score_curve(scored: DataFrame, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Per distinct score, the hits and misses among all scores at or above it."""
    counts, keys = _grouped(_falling_counts(scored, by), list(by))
    curve = scan(
        counts, keys, ["falling"], {"tp_before": col("pos"), "fp_before": col("neg"), "points_before": F.lit(1)}, ranges=ranges
    )
    return curve.select(
        *keys, "score", "pos", "neg", "points_before",
        (col("tp_before") + col("pos")).alias("tp"),
        (col("fp_before") + col("neg")).alias("fp"),
    )


def _with_totals(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Attach class totals and the number of points of a curve; groups with one class have no curve."""
    totals = curve.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.count(F.lit(1)).alias("points")
    )
    return curve.join(totals, keys).where((col("positives") > 0) & (col("negatives") > 0))


def rank_metrics(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """ROC AUC by rank sum with averaged ties, average precision, Brier score and class sizes."""
    curve, keys = score_curve(scored, by), list(by) or ["_all"]
    positives, negatives = F.sum("pos"), F.sum("neg")
    score = col("score")
    # fp counts negatives at or above a score, so wins below it are total minus fp.
    sums = curve.groupBy(*keys).agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.sum(col("pos") * (col("fp") - 0.5 * col("neg"))).alias("losses"),
        F.sum(_ratio(col("pos") * col("tp"), col("tp") + col("fp"))).alias("gain"),
        F.sum(col("pos") * (score - 1) * (score - 1) + col("neg") * score * score).alias("squares"),
    )
    p, n = col("positives"), col("negatives")
    both = (p > 0) & (n > 0)
    return sums.select(
        *by,
        (p + n).alias("rows"),
        _ratio(p, p + n).alias("positive_rate"),
        F.when(both, 1 - F.try_divide(col("losses"), p * n)).alias("roc_auc"),
        F.when(both, F.try_divide(col("gain"), p)).alias("average_precision"),
        _ratio(col("squares"), p + n).alias("brier_score"),
    )


def classification_metrics(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """All metrics of a scored set at its recommended threshold, one row per group."""
    at_best = confusion_at_best(scored, by).withColumnRenamed("threshold", "recommended_threshold")
    ranks = rank_metrics(scored, by)
    ranked = [c for c in ranks.columns if c not in by]
    if by:
        both = at_best.join(ranks, list(by))
    else:  # one row each
        both = at_best.withColumn("_ranks", ranks.select(F.struct(*ranked)).scalar()).select("*", "_ranks.*")
    return both.select(
        *by,
        "recommended_threshold", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc",
        "average_precision", "brier_score", "positive_rate", "positive_prediction_rate", "rows",
        "tn", "fp", "fn", "tp",
    )


def roc_points(scored: DataFrame, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """ROC points by falling score, without points on a straight line, preceded by (0, 0).

    ``point`` numbers them from 0; the origin has no threshold. Empty for a one-class group.
    """
    counts, keys = _grouped(_falling_counts(scored, by), list(by))
    flagged = scan(counts, keys, ["falling"], following=["pos", "neg"], ranges=ranges)
    bend = (col("next_pos") != col("pos")) | (col("next_neg") != col("neg"))
    curve = scan(
        flagged.withColumnRenamed("is_first", "highest").withColumn("kept", col("highest") | F.coalesce(bend, F.lit(True))),
        keys, ["falling"], {"tp": col("pos"), "fp": col("neg"), "point": col("kept").cast("int")},
    )
    with_totals = _with_totals(curve, keys)
    points = with_totals.where("kept").select(
        *by,
        (col("point") + 1).alias("point"),
        ((col("fp") + col("neg")) / col("negatives")).alias("false_positive_rate"),
        ((col("tp") + col("pos")) / col("positives")).alias("true_positive_rate"),
        col("score").alias("threshold"),
    )
    origin = with_totals.where("highest").select(
        *by,
        F.lit(0).cast("bigint").alias("point"),
        F.lit(0.0).alias("false_positive_rate"),
        F.lit(0.0).alias("true_positive_rate"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return points.unionByName(origin)


def pr_points(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision and recall by rising score, ended by (1, 0) without a threshold."""
    curve = _with_totals(score_curve(scored, by), list(by) or ["_all"])
    point = col("points") - 1 - col("points_before")
    points = curve.select(
        *by,
        point.alias("point"),
        _ratio(col("tp"), col("tp") + col("fp")).alias("precision"),
        (col("tp") / col("positives")).alias("recall"),
        col("score").alias("threshold"),
    )
    end = curve.where(col("points_before") == 0).select(
        *by,
        col("points").alias("point"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return points.unionByName(end)


def curve_sample(points: DataFrame, max_points: int = CURVE_POINTS) -> DataFrame:
    """At most ``max_points`` evenly spaced points of one curve, both ends included.

    Point k stays if some i in 0..max_points-1 has rint(i * step) = k; only three i can.
    """
    points = settle(points)
    last = points.agg(F.max("point").alias("m")).scalar()
    step = last / (max_points - 1)
    near = F.rint(col("point") / step)
    hit = reduce(
        lambda a, b: a | b,
        [
            (near + d >= 0) & (near + d <= max_points - 1) & (F.rint((near + d) * step) == col("point"))
            for d in (-1, 0, 1)
        ],
    )
    return points.where((last < max_points) | hit)


def classification_report(counts: DataFrame) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support from one row of counts."""
    tp, fp, fn, tn = (col(c) for c in ("tp", "fp", "fn", "tn"))

    def scores(hit: Column, false: Column, missed: Column) -> list[Column]:
        return [_ratio(hit, hit + false), _ratio(hit, hit + missed), _ratio(2 * hit, 2 * hit + false + missed)]

    negative, positive = scores(tn, fn, fp), scores(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    # A class counts if it occurs among labels or predictions.
    seen0, seen1 = n0 + fn > 0, n1 + fp > 0
    seen = seen0.cast("int") + seen1.cast("int")
    weighted = [_ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(negative, positive)]
    macro = [_ratio(a + b, seen) for a, b in zip(negative, positive)]
    names = ("precision", "recall", "f1_score")
    rows = [
        ("No Reorder", negative, n0, seen0),
        ("Reorder", positive, n1, seen1),
        ("Macro Avg", macro, n0 + n1, F.lit(True)),
        ("Weighted Avg", weighted, n0 + n1, F.lit(True)),
    ]
    return counts.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(label).alias("class"),
                    *[v.alias(n) for n, v in zip(names, values)],
                    support.alias("support"),
                    shown.alias("shown"),
                )
                for label, values, support, shown in rows
            ])
        )
    ).where("shown").drop("shown")


def scale_scores(df: DataFrame, decision: str = "decision", name: str = "score") -> DataFrame:
    """Map unbounded decision values to [0, 1] by their range; a constant value becomes 0.5."""
    low = df.agg(F.min(decision).alias("v")).scalar()
    high = df.agg(F.max(decision).alias("v")).scalar()
    return df.withColumn(
        name, F.when(low == high, F.lit(0.5)).otherwise(F.try_divide(col(decision) - low, high - low))
    )


def model_comparison(metrics: DataFrame) -> DataFrame:
    """One row per model, best first; ``place`` 1 is the selected model."""
    return metrics.select(
        "model_name", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc",
        "recommended_threshold", "positive_prediction_rate", "average_precision", "brier_score",
    ).orderBy(
        col("roc_auc").isNotNull().desc(), F.coalesce("roc_auc", F.lit(0.0)).desc(),
        F.coalesce("f1", F.lit(0.0)).desc(), "model_name",
    )
