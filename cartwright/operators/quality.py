"""Data-quality counts: one scan per table for null checks, map-side combined key counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


class QualityError(ValueError):
    """Raised by the gate with the names of all failed checks."""


def null_counts(df: DataFrame, table_name: str, columns: list[str]) -> DataFrame:
    """(table_name, check_name, invalid_count), every column counted in the same scan."""
    if not columns:
        raise ValueError("no columns to check")
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_not_null") for c in columns])
    return counts.unpivot([], [f"{c}_not_null" for c in columns], "check_name", "invalid_count").select(
        F.lit(table_name).alias("table_name"), "check_name", "invalid_count"
    )


def duplicate_keys(df: DataFrame, table_name: str, keys: list[str], check_name: str) -> DataFrame:
    """Number of key values that occur more than once; a NULL key is a value like any other."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("invalid_count"))
        .select(F.lit(table_name).alias("table_name"), F.lit(check_name).alias("check_name"), "invalid_count")
    )


def key_checks(
    df: DataFrame,
    table_name: str,
    keys: list[str],
    check_name: str,
    required: list[str],
    count_null_keys: bool = True,
) -> DataFrame:
    """Null checks and the unique check of one table in one pass.

    Rows are combined per key map-side, with their null counts; the groups then give both. A
    declared unique test leaves NULL keys to the null check (``count_null_keys=False``).
    """
    groups = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in required],
    )
    repeated = F.col("_n") > 1
    if not count_null_keys:
        for key in keys:
            repeated = repeated & F.col(key).isNotNull()
    names = [f"{c}_not_null" for c in required]
    counts = groups.agg(
        *[
            F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(name) for c, name in zip(required, names)
        ],
        F.count_if(repeated).alias(check_name),
    )
    return counts.unpivot([], [*names, check_name], "check_name", "invalid_count").select(
        F.lit(table_name).alias("table_name"), "check_name", "invalid_count"
    )


def orphan_rows(
    df: DataFrame, parent: DataFrame, key: str, table_name: str, check_name: str
) -> DataFrame:
    """Rows whose key is set but absent from ``parent``. Rows are counted per key before the join,
    so a key with a third of all rows meets the join as one row."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_key.join(parent.select(key), key, "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("invalid_count"))
        .select(F.lit(table_name).alias("table_name"), F.lit(check_name).alias("check_name"), "invalid_count")
    )


def raw_checks(orders: DataFrame, products: DataFrame, lines: DataFrame) -> DataFrame:
    """The eight checks of the raw tables in four passes."""
    line_table = "raw_order_products"
    return reduce(
        DataFrame.unionByName,
        [
            key_checks(orders, "raw_orders", ["order_id"], "order_id_unique", ["order_id"]),
            key_checks(products, "raw_products", ["product_id"], "product_id_unique", ["product_id"]),
            key_checks(
                lines, line_table, ["order_id", "product_id"], "order_product_unique",
                ["order_id", "product_id"],
            ),
            orphan_rows(lines, products, "product_id", line_table, "product_id_valid"),
        ],
    )


def quality_report(checks: DataFrame) -> DataFrame:
    return checks.select(
        "table_name",
        "check_name",
        "invalid_count",
        F.when(F.col("invalid_count") == 0, "Passed").otherwise("Failed").alias("status"),
    ).orderBy("table_name", "check_name")


def quality_gate(checks: DataFrame) -> DataFrame:
    """Run every check, then fail with the full list. The report has one row per check."""
    report = quality_report(checks)
    failed = [f"{r.table_name}.{r.check_name}" for r in report.where(F.col("status") != "Passed").collect()]
    if failed:
        raise QualityError("Data validation failed for checks: " + ", ".join(failed))
    return report


def model_constraints(tables: dict[str, DataFrame], constraints: dict) -> DataFrame:
    """Declared unique and not-null tests of all models as one report."""
    parts = [
        key_checks(tables[name], name, [unique], f"{unique}_unique", required, count_null_keys=False)
        if unique
        else null_counts(tables[name], name, required)
        for name, (unique, required) in constraints.items()
    ]
    return quality_report(reduce(DataFrame.unionByName, parts))


def quality_summary(report: DataFrame) -> DataFrame:
    """One row for decisions: failures, total, status word and detail text."""
    failed, total = F.col("data_quality_failures"), F.col("total_checks")
    return report.agg(
        F.count_if(F.col("status") != "Passed").alias("data_quality_failures"),
        F.count(F.lit(1)).alias("total_checks"),
    ).withColumns({
        "data_quality_status": F.when(failed == 0, "passed").otherwise("failed"),
        "data_quality_detail": F.format_string("%d failed checks out of %d", failed, total),
    })


def unavailable_summary(df_session, detail: str) -> DataFrame:
    """What stands in for the summary when the checks themselves could not run: one failure."""
    return df_session.range(1).select(
        F.lit(1).cast("bigint").alias("data_quality_failures"),
        F.lit(0).cast("bigint").alias("total_checks"),
        F.lit("unavailable").alias("data_quality_status"),
        F.lit(detail).alias("data_quality_detail"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ],
    )
