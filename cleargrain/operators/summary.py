"""Counts, shares and top lists over the four reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import percent
from .profile import top_missing


def _counted(report: DataFrame, label: str, count: str) -> DataFrame:
    return report.groupBy(label).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), label)


def missing_summary(missing: DataFrame) -> DataFrame:
    """Columns per recommendation."""
    return _counted(missing, "recommendation", "column_count")


def duplicate_summary(duplicates: DataFrame) -> DataFrame:
    """Groups per duplicate type."""
    return _counted(duplicates, "duplicate_type", "group_count")


def variant_summary(variants: DataFrame) -> DataFrame:
    """Variant pairs per status."""
    return _counted(variants, "status", "pair_count")


def cleaning_summary(mapping: DataFrame) -> DataFrame:
    """Mappings per status."""
    return _counted(mapping, "status", "mapping_count")


def status_counts(mapping: DataFrame) -> DataFrame:
    """Automatic corrections and manual reviews."""
    return mapping.agg(
        F.count_if(F.col("status") == "accepted").alias("accepted_count"),
        F.count_if(F.col("status") == "review").alias("review_count"),
    )


def accepted_ratio(variants: DataFrame) -> DataFrame:
    """Number of mapped pairs and the percentage accepted."""
    return variants.agg(F.count(F.lit(1)).alias("mapped_pairs"), F.count_if(F.col("status") == "accepted").alias("n")).select(
        "mapped_pairs", percent(F.col("n"), F.col("mapped_pairs")).alias("accepted_ratio")
    )


def top_duplicate_groups(duplicates: DataFrame, n: int = 10) -> DataFrame:
    """First groups in report order."""
    return duplicates.orderBy("duplicate_type", F.desc("occurrences"), "rule_name", "duplicate_key").limit(n)


def top_variant_pairs(variants: DataFrame, n: int = 10) -> DataFrame:
    """First pairs in report order."""
    return variants.orderBy(
        "status", F.desc("similarity_score"), F.desc("canonical_count"), F.desc("variant_count"), "variant_value"
    ).limit(n)


def distribution(summary: DataFrame, label: str, value: str) -> DataFrame:
    """Each label's value and share of the total.

    The total is a scalar subquery, so no window gathers the labels into one task.
    """
    total = summary.agg(F.sum(value).alias("total")).scalar()
    return summary.select(
        F.col(label).cast("string").alias("label"),
        F.col(value).alias("value"),
        percent(F.col(value), total).alias("share"),
    )


def bars(report: DataFrame, label: str, value: str, n: int = 10) -> DataFrame:
    """The top ``n`` values, scaled to the largest of them (at least one)."""
    top = report.orderBy(F.desc(value), label).limit(n)
    largest = top.agg(F.greatest(F.max(F.col(value).cast("double")), F.lit(1.0)).alias("largest")).scalar()
    return top.select(
        F.col(label).cast("string").alias("label"),
        F.col(value).cast("double").alias("value"),
        percent(F.col(value), largest).alias("width"),
    )


def largest_duplicate_groups(duplicates: DataFrame, n: int = 12) -> DataFrame:
    """Groups with the most rows, whatever their type."""
    return duplicates.orderBy(F.desc("occurrences"), "duplicate_type", "rule_name", "duplicate_key").limit(n)


def first_missing_columns(missing: DataFrame, n: int = 12) -> DataFrame:
    return top_missing(missing, n)


def top_variants(variants: DataFrame, status: str, n: int = 10) -> DataFrame:
    """Best-scored pairs of one status."""
    return (
        variants.filter(F.col("status") == status)
        .orderBy(F.desc("similarity_score"), F.desc("canonical_count"), F.desc("variant_count"), "variant_value")
        .limit(n)
    )


def facts(section: str, rows: DataFrame, label: str | None, value: str) -> DataFrame:
    """Rows in the common (section, label, value) shape."""
    name = F.col(label).cast("string") if label else F.lit(value)
    return rows.select(F.lit(section).alias("section"), name.alias("label"), F.col(value).cast("double").alias("value"))


def final_facts(
    table_size: DataFrame, missing: DataFrame, duplicates: DataFrame, variants: DataFrame, mapping: DataFrame
) -> DataFrame:
    """Every figure of the closing report in one table."""
    statuses = status_counts(mapping)
    parts = [
        facts("dataset", table_size, None, "row_count"),
        facts("dataset", table_size, None, "column_count"),
        facts("missing_summary", missing_summary(missing), "recommendation", "column_count"),
        facts("duplicate_summary", duplicate_summary(duplicates), "duplicate_type", "group_count"),
        facts("variant_summary", variant_summary(variants), "status", "pair_count"),
        facts("cleaning_summary", cleaning_summary(mapping), "status", "mapping_count"),
        facts("top_missing", top_missing(missing), "column_name", "missing_percentage"),
        facts("top_duplicates", top_duplicate_groups(duplicates), "duplicate_key", "occurrences"),
        facts("top_variants", top_variant_pairs(variants), "variant_value", "similarity_score"),
        facts("corrections", statuses, None, "accepted_count"),
        facts("corrections", statuses, None, "review_count"),
    ]
    return reduce(DataFrame.unionByName, parts)
