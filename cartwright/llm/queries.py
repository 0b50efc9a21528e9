"""The corpus operators as named queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat, decontaminate, filter_audit, kn_quality, language, licenses, line_dedup, manifest, near_dup, packing, quality_rules,
    secrets, token_store,
)
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.findings(table(spark, sf_dir, "documents")))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.with_probe(spark, table(spark, sf_dir, "conversations"))))


def op6_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_digests(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets, op2_licences, op3_packing, op4_quality_rules, op5_chat, op6_kn_quality,
        op7_decontamination, op8_language, op9_line_dedup, op10_near_dup,
        op11_token_ids, op12_filter_audit, op13_manifest,
    )
}

#: The other operators have no SQL: tests hold them against brute force.
SQL = {
    "op4_quality_rules": quality_rules.REPORT_SQL,
    "op5_chat": chat.READ_SQL,
    "op7_decontamination": decontaminate.REPORT_SQL,
    "op9_line_dedup": line_dedup.REPORT_SQL,
    "op12_filter_audit": filter_audit.AUDIT_SQL,
    "op13_manifest": manifest.AUDIT_SQL,
}
