"""Session settings and durable cut points."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Measured-small build sides are hashed instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    # No call-site capture per column expression: plans are built faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "cartwright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def _scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder ``spark.checkpoint.dir``; without that setting a
    folder under the warehouse, which all executors see under every master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{folder.rstrip('/')}/cartwright-{context.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table of the shared scratch folder and continue from there.

    For a result that feeds several branches of a plan: none of them recomputes it, each reads
    only its columns, its true size is known to the planner, and a lost executor costs a file
    read, not the lineage behind it.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> None:
    """Remove this application's settled tables, once no plan reads them any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
