"""Model training, evaluation and batch scoring with distributed estimators."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import col

from cartwright.operators import metrics as m
from cartwright.operators.quality import QualityError
from cartwright.operators.running import scan
from cartwright.schemas import FEATURE_COLUMNS, FEATURE_UPPER_BOUNDS, TARGET_COLUMN
from cartwright.session import settle
from cartwright.sources.published import Published

TEST_SHARE = 0.2
SEED = 42
#: Rows in one partition of a fit, and the fewest partitions.
FIT_ROWS = 100_000
FEWEST_PARTS = 8


def validate_training(df: DataFrame, target: str = TARGET_COLUMN) -> None:
    """Raise unless there are rows, a target with two classes and numeric features."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' is missing from the training data")
    present = [c for c in FEATURE_COLUMNS if c in df.columns]
    if not present:
        raise ValueError("No numeric feature columns found for model training")
    wrong = [c for c in present if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError("Feature columns must be numeric: " + ", ".join(wrong))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if facts.rows == 0:
        raise ValueError("The training data is empty")
    if facts.lo is None or facts.lo == facts.hi:
        raise ValueError(f"Target column '{target}' must contain at least two classes")


def training_matrix(df: DataFrame, target: str = TARGET_COLUMN) -> DataFrame:
    """Features in fixed order as doubles, absent or missing ones 0, and an integer label."""
    ids = [c for c in ("user_id", "order_id") if c in df.columns]
    features = [
        F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
        if c in df.columns
        else F.lit(0.0).alias(c)
        for c in FEATURE_COLUMNS
    ]
    return df.select(*ids, *features, col(target).cast("int").alias("label"))


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "order_id", share: float = TEST_SHARE, seed: int = SEED,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``is_test``: per class, the first ``ceil(share * n)`` rows in md5 order of the key.

    Repeatable on any partitioning. Classes are kept apart only if the smallest has two rows.
    """
    columns, df = df.columns, settle(df)
    smallest = (
        df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).scalar()
    )
    mixed = F.md5(F.concat_ws("-", col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumns({
        "_stratum": F.when(smallest >= 2, col(label)).otherwise(-1),
        "_mixed": mixed,
    })
    ranked = scan(rows, ["_stratum"], ["_mixed", key], {"_place": F.lit(1)}, ranges=ranges)
    # Two classes, so two rows at most.
    sizes = ranked.groupBy("_stratum").agg(F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("_quota"))
    return ranked.join(F.broadcast(sizes), "_stratum").select(
        *columns, (col("_place") < col("_quota")).alias("is_test")
    )


def with_class_weight(split: DataFrame) -> DataFrame:
    """Balanced weights n / (2 * rows of the class), measured on the train part."""
    train = split.where(~col("is_test"))
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    positive = train.agg(F.sum("label").alias("n")).scalar()
    of_class = F.when(col("label") == 1, positive).otherwise(n - positive)
    return split.withColumn("class_weight", F.try_divide(n, 2 * of_class))


def candidate_models(seed: int = SEED, scale: float = 1.0, train_rows: int = 0) -> dict[str, Pipeline]:
    """The three candidates. ``scale`` < 1 shrinks tree counts for quick runs.

    A unit L2 penalty on summed losses is 1 / rows of the mean loss that Spark minimises.
    """

    def assemble(out: str = "features") -> VectorAssembler:
        return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol=out)

    def trees(n: int) -> int:
        return max(2, round(n * scale))

    return {
        "random_forest": Pipeline(stages=[
            assemble(),
            RandomForestClassifier(
                numTrees=trees(80), maxDepth=12, minInstancesPerNode=2, seed=seed, weightCol="class_weight",
                # Where a row stands in each tree is kept, not found again from the root for every level.
                cacheNodeIds=True,
            ),
        ]),
        "logistic_regression": Pipeline(stages=[
            assemble("raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(
                maxIter=1000, regParam=1.0 / train_rows if train_rows else 0.0, weightCol="class_weight",
                standardization=False,
            ),
        ]),
        "gradient_boosting": Pipeline(stages=[
            assemble(),
            GBTClassifier(maxIter=trees(120), stepSize=0.05, maxDepth=3, seed=seed),
        ]),
    }


def probability_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``score``, the probability of class 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "raw_features", "rawPrediction", "probability", "prediction"
    )


def fit_rows(train: DataFrame, rows: int, key: str = "order_id") -> DataFrame:
    """``train`` in even partitions, as many as its rows ask for, each in order of the key.

    Estimators sample rows by partition and place in it, so the models follow from the rows, not from the files
    they lie in or the number of cores; and no core waits for a partition larger than the others.
    """
    parts = max(FEWEST_PARTS, -(-rows // FIT_ROWS))
    return train.repartition(parts, key).sortWithinPartitions(key)


def fit_candidates(
    rows: DataFrame,
    seed: int = SEED,
    scale: float = 1.0,
    names: tuple[str, ...] | None = None,
    key: str = "order_id",
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit the candidates on the train part; return them and the scored test rows of all.

    The split set is read once per boosting round, so it is settled before fitting.
    """
    split = settle(with_class_weight(stratified_split(rows, key=key, seed=seed)))
    train, test = split.where(~col("is_test")), split.where("is_test")
    train_rows = train.count()
    train = fit_rows(train, train_rows, key)
    models = {
        name: pipeline.fit(train)
        for name, pipeline in candidate_models(seed, scale, train_rows).items()
        if names is None or name in names
    }
    scored = [
        probability_scores(model, test).select(F.lit(name).alias("model_name"), "label", "score")
        for name, model in models.items()
    ]
    return models, reduce(DataFrame.unionByName, scored)


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """One row per feature: importance, or absolute coefficient, as a share of the sum."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = [float(v) for v in last.featureImportances.toArray()]
    elif hasattr(last, "coefficients"):
        values = [abs(float(v)) for v in last.coefficients.toArray()]
    else:
        values = [0.0] * len(FEATURE_COLUMNS)
    rows = spark.createDataFrame(list(zip(FEATURE_COLUMNS, values)), "feature string, value double")
    return normalise_importance(rows)


def normalise_importance(rows: DataFrame) -> DataFrame:
    """Share of the sum; all zeros stay zeros. The input has one row per feature."""
    total = rows.agg(F.sum("value").alias("v")).scalar()
    return rows.select(
        "feature", F.when(total == 0, col("value")).otherwise(F.try_divide(col("value"), total)).alias("importance")
    ).orderBy(F.desc("importance"), "feature")


def driver_share(importance: DataFrame, n: int = 3) -> DataFrame:
    top = importance.orderBy(F.desc("importance"), "feature").limit(n)
    return top.agg(F.sum("importance").alias("top_share"))


def metric_gap_flag(metrics: DataFrame) -> DataFrame:
    gap = F.coalesce("accuracy", F.lit(0.0)) - F.coalesce("balanced_accuracy", F.lit(0.0))
    flag = (gap >= 0.15) | (F.coalesce("positive_rate", F.lit(0.0)) >= 0.8)
    return metrics.withColumns({"metric_gap": gap, "metric_gap_warning": flag})


def model_recommendations(metrics: DataFrame, importance: DataFrame) -> DataFrame:
    """Advice whose rule fires, per metrics row, in rule order."""

    def known(name: str) -> Column:
        return F.coalesce(col(name), F.lit(0.0))

    top_two = importance.orderBy(F.desc("importance"), "feature").limit(2).agg(
        F.coalesce(F.sum("importance"), F.lit(0.0)).alias("v")
    ).scalar()
    # Thresholds, priorities, actions and expected impacts.
    rules = (
        (known("positive_rate") >= 0.8, "high",
         "Monitor class imbalance before using the model for automated targeting.",
         "The dataset contains many reorder-positive examples, so accuracy alone can overstate model quality. "
         "Use balanced accuracy, ROC AUC, and threshold analysis together."),
        (known("balanced_accuracy") < 0.6, "high",
         "Treat the current classifier as a ranking signal, not a final automated decision.",
         "Balanced accuracy is close to random because the no-reorder class is hard to detect. "
         "Use the probability score for prioritization until richer negative-class features are added."),
        (F.coalesce(col("roc_auc") < 0.72, F.lit(False)), "medium",
         "Add richer behavioral features such as recency, product affinity, and department mix.",
         "Improves separation between likely reorders and customers who may churn."),
        (known("recall") < known("precision"), "medium",
         "Tune the prediction threshold based on campaign goals.",
         "Lower thresholds catch more potential reorderers; higher thresholds reduce false positives "
         "for expensive retention campaigns."),
        (top_two > 0.85, "medium",
         "Reduce dependence on only a few features.",
         "A broader feature set usually makes the model more stable and easier to explain to business users."),
    )
    advice = F.array(*[
        F.struct(
            fires.alias("fires"), F.lit(no).alias("rule_no"), F.lit(priority).alias("priority"),
            F.lit(action).alias("action"), F.lit(impact).alias("expected_impact"),
        )
        for no, (fires, priority, action, impact) in enumerate(rules, 1)
    ])
    keep = [c for c in ("model_name", "run_id") if c in metrics.columns]
    return (
        metrics.select(*keep, F.inline(advice))
        .where("fires")
        .select(*keep, "rule_no", "priority", "action", "expected_impact")
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Store a model beside earlier ones and make it current once it is whole."""
    folder = f"data/{uuid4().hex}"
    model.write().save(f"{path}/{folder}")
    Published(SparkSession.active(), path).commit([{"folder": folder}])


def model_folder(spark: SparkSession, path: str) -> str:
    """Where the current model of ``path`` is stored."""
    return f"{path}/{Published(spark, path).manifest()['parts'][0]['folder']}"


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(model_folder(SparkSession.active(), path))


def range_violations(df: DataFrame) -> DataFrame:
    """Rows per feature outside its contract: below 0 or above its upper bound. One scan."""
    present = [c for c in FEATURE_COLUMNS if c in df.columns]

    def broken(c: str) -> Column:
        low = col(c) < 0
        high = FEATURE_UPPER_BOUNDS.get(c)
        return low | (col(c) > high) if high is not None else low

    counts = df.agg(*[F.count_if(broken(c)).alias(c) for c in present])
    return counts.unpivot([], present, "feature", "violations")


def batch_score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score a feature table with a fitted model; every feature must be present."""
    missing = [c for c in FEATURE_COLUMNS if c not in df.columns]
    if missing:
        raise QualityError("Missing required model features: " + ", ".join(missing))
    return probability_scores(model, df).withColumnRenamed("score", "reorder_probability")


def compare_models(scored: DataFrame) -> DataFrame:
    return m.model_comparison(m.classification_metrics(scored, ["model_name"]))
