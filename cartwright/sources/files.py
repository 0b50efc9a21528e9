"""CSV loading, run history and artifact sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cartwright.schemas import RAW_FILES, RAW_SCHEMAS, RUN_HISTORY_SCHEMA
from cartwright.sources.published import Published


def normalize_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def scan_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV with a header. With a schema, columns are matched by normalised header name and cast;
    one that cannot be read as its type fails the load. Large files are split across tasks."""
    try:
        raw = normalize_columns(spark.read.option("header", True).csv(path))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"Required source file not found: {path}") from exc
        raise
    if schema is None:
        return raw
    return raw.select(*[
        F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


Audit = Callable[[DataFrame], DataFrame]


def load_replace(
    spark: SparkSession, path: str, table_path: str, schema: StructType | None = None, audit: Audit | None = None
) -> int:
    """Make a CSV the whole table; returns the rows written. A load that fails leaves the table as it is."""
    return Published(spark, table_path).replace(scan_csv(spark, path, schema), audit)


def load_append(
    spark: SparkSession, path: str, table_path: str, schema: StructType | None = None, audit: Audit | None = None
) -> int:
    return Published(spark, table_path).append(scan_csv(spark, path, schema), audit)


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The current version of a loaded table."""
    return Published(spark, table_path).read()


def load_dataset(spark: SparkSession, folder: str, warehouse: str, audits: dict[str, Audit] | None = None) -> dict[str, int]:
    """All raw tables from their CSV files; the first failure ends the load."""
    return {
        name: load_replace(spark, f"{folder}/{file}", f"{warehouse}/{name}", RAW_SCHEMAS[name], (audits or {}).get(name))
        for file, name in RAW_FILES.items()
    }


def append_runs(records: DataFrame, path: str) -> None:
    Published(records.sparkSession, path, RUN_HISTORY_SCHEMA).append(records)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run history in time order; an empty one before the first run."""
    return Published(spark, path, RUN_HISTORY_SCHEMA).read().orderBy("run_timestamp")


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_importance_csv(importance: DataFrame, path: str) -> None:
    importance.write.mode("overwrite").option("header", True).csv(path)
