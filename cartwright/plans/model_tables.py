"""Stored models as tables: tree nodes and coefficients as rows, scored and explained by column expressions.

A stored pipeline is read back as plain rows, so a model can be inspected, compared with another or scored
where no estimator is at hand. Tree tables have one row per node (tree, weight, node, feature, threshold,
left, right, value, gain, rows): a leaf has left -1, other nodes send values up to the threshold left. Linear tables
have one row per feature (feature, coefficient, mean, deviation) and the intercept without a feature.

A model is bounded by its own parameters, not by the data: it enters a scoring plan as one array.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import col

from cartwright.plans.training import model_folder
from cartwright.schemas import FEATURE_COLUMNS

FOREST, BOOSTED, LINEAR = "forest", "boosted", "linear"
KINDS = {
    "RandomForestClassificationModel": FOREST,
    "GBTClassificationModel": BOOSTED,
    "LogisticRegressionModel": LINEAR,
}
NODE = (
    "tree int, weight double, node int, feature string, threshold double, left int, right int, value double, "
    "gain double, rows double"
)
TERM = "feature string, coefficient double, mean double, deviation double"
#: No estimator grows deeper trees.
MOST_LEVELS = 30


def stored_model(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Kind and table of the current pipeline that ``save_model`` wrote."""
    path = model_folder(spark, path)
    stages = spark.read.json(f"{path}/stages/*/metadata").select(F.substring_index("class", ".", -1).alias("name"), "uid")
    found = [(r["name"], r["uid"]) for r in stages.collect()]  # one row per stage
    kind, uid = next((KINDS[name], uid) for name, uid in found if name in KINDS)
    if kind == LINEAR:
        scaler = next(uid for name, uid in found if name == "StandardScalerModel")
        return kind, _terms(spark, f"{path}/stages/*{uid}/data", f"{path}/stages/*{scaler}/data")
    return kind, _nodes(spark, f"{path}/stages/*{uid}", kind)


def _nodes(spark: SparkSession, stage: str, kind: str) -> DataFrame:
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(col("_1").alias("treeID"), col("_3").alias("weight"))
    stats = col("nodeData.impurityStats")
    feature = F.array(*map(F.lit, FEATURE_COLUMNS))[F.greatest(col("nodeData.split.featureIndex"), F.lit(0))]
    inner = col("nodeData.leftChild") >= 0
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{stage}/data").join(weights, "treeID").select(
        col("treeID").alias("tree"),
        "weight",
        col("nodeData.id").alias("node"),
        F.when(inner, feature).alias("feature"),
        F.when(inner, col("nodeData.split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        col("nodeData.leftChild").alias("left"),
        col("nodeData.rightChild").alias("right"),
        # A forest's node holds class weights, a boosted tree's a step.
        (F.try_divide(stats[1], total) if kind == FOREST else col("nodeData.prediction")).alias("value"),
        F.when(inner, col("nodeData.gain")).alias("gain"),
        (total if kind == FOREST else stats[0]).alias("rows"),
    )


def _terms(spark: SparkSession, model: str, scaler: str) -> DataFrame:
    fitted = spark.read.parquet(model).first()  # one row: as many numbers as features
    scales = spark.read.parquet(scaler).select(vector_to_array("mean").alias("m"), vector_to_array("std").alias("s")).first()
    coefficients = [float(v) for v in fitted["coefficientMatrix"].toArray()[0]]
    rows = list(zip(FEATURE_COLUMNS, coefficients, scales["m"], scales["s"]))
    return spark.createDataFrame([*rows, (None, float(fitted["interceptVector"][0]), 0.0, 1.0)], TERM)


def _logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _trees(table: DataFrame) -> Column:
    """The whole ensemble as one value: per tree its weight and its nodes by number."""
    index = F.array_position(F.array(*map(F.lit, FEATURE_COLUMNS)), col("feature")) - 1
    node = F.struct("node", index.cast("int").alias("feature"), "threshold", "left", "right", "value")
    trees = table.groupBy("tree", "weight").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return trees.agg(F.sort_array(F.collect_list(F.struct("tree", "weight", "nodes")))).scalar()


def _tree_score(kind: str, model: Column) -> Column:
    x = F.array(*[col(c).cast("double") for c in FEATURE_COLUMNS])

    def leaf(nodes: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            here = nodes[at]
            down = F.when(x[here["feature"]] <= here["threshold"], here["left"]).otherwise(here["right"])
            return F.when(here["left"] < 0, at).otherwise(down)

        return F.aggregate(F.sequence(F.lit(1), F.least(F.size(nodes), F.lit(MOST_LEVELS))), F.lit(0), step)

    def step_of(tree: Column) -> Column:
        value = tree["nodes"][leaf(tree["nodes"])]["value"]
        return F.struct(tree["weight"].alias("w"), (tree["weight"] * value).alias("v"))

    return F.aggregate(
        F.transform(model, step_of),
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v")),
        lambda a, s: F.struct((a["w"] + s["w"]).alias("w"), (a["v"] + s["v"]).alias("v")),
        lambda a: a["v"] / a["w"] if kind == FOREST else _logistic(2 * a["v"]),
    )


def _weights(table: DataFrame) -> Column:
    """The linear model as one value: its terms by feature, the intercept under the empty name."""
    term = F.struct("coefficient", "mean", "deviation")
    return table.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("feature", F.lit("")), term)))).scalar()


def _linear_score(model: Column) -> Column:
    x = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("double").alias("x")) for c in FEATURE_COLUMNS])

    def add(total: Column, one: Column) -> Column:
        t = model[one["name"]]
        scaled = F.when(t["deviation"] > 0, (one["x"] - t["mean"]) / t["deviation"]).otherwise(0.0)
        return total + F.coalesce(t["coefficient"] * scaled, F.lit(0.0))

    return _logistic(F.aggregate(x, F.coalesce(model[""]["coefficient"], F.lit(0.0)), add))


def score(kind: str, table: DataFrame, rows: DataFrame, name: str = "score") -> DataFrame:
    """``rows`` with the probability of class 1 by the model in ``table``; all features must be present."""
    held = rows.withColumn("_model", _weights(table) if kind == LINEAR else _trees(table))
    probability = _linear_score(col("_model")) if kind == LINEAR else _tree_score(kind, col("_model"))
    return held.withColumn(name, probability).drop("_model")


def importance(kind: str, table: DataFrame) -> DataFrame:
    """Per feature its share: of absolute coefficients, or of the gain its splits bring to the rows they see.

    In a forest every tree counts the same, in a boosted ensemble every split.
    """
    spark = table.sparkSession
    if kind == LINEAR:
        found = table.where(col("feature").isNotNull()).select("feature", F.abs("coefficient").alias("value"))
    else:
        gains = table.where(col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum(col("gain") * col("rows")).alias("gain"))
        if kind == FOREST:
            whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
            gains = gains.join(whole, "tree").select("feature", F.try_divide("gain", "whole").alias("gain"))
        found = gains.groupBy("feature").agg(F.sum("gain").alias("value"))
    every = spark.createDataFrame([(c,) for c in FEATURE_COLUMNS], "feature string")
    values = every.join(found, "feature", "left").select("feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    total = values.agg(F.sum("value")).scalar()
    share = F.when(total == 0, col("value")).otherwise(F.try_divide(col("value"), total))
    return values.select("feature", share.alias("importance"))
