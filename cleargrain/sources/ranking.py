"""Choosing the data table among several candidates by their headers and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that mark a header as a data column, and the size rules for a candidate.
HEADER_WORDS = ("recipient", "agreement", "ref", "owner_org", "province", "city", "name", "number", "date", "value")
MIN_HEADERS, MIN_SCORE = 5, 4


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Name, row count and header of each table."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(place).alias("position"),
            F.lit(name).alias("table_name"),
            "row_count",
            F.array(*[F.lit(c) for c in table.columns]).alias("headers"),
        )
        for place, (name, table) in enumerate(tables.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def _coerced(cell: Column, place: Column) -> Column:
    text = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(text == "", F.format_string("unnamed_column_%02d", place + 1)).otherwise(text)


def rank_tables(profiles: DataFrame) -> DataFrame:
    """Score each table profile (position, table_name, row_count, headers) and rank it.

    A candidate holds rows, has mostly filled headers and enough headers that look like data.
    """
    width = F.size("headers")
    looks_like_data = lambda header: reduce(
        lambda a, b: a | b, [F.contains(F.lower(header), F.lit(word)) for word in HEADER_WORDS]
    )
    scored = (
        profiles.withColumn("column_count", width)
        .withColumn(
            "non_empty_headers", F.size(F.filter("headers", lambda h: F.coalesce(F.trim(h) != "", F.lit(False))))
        )
        .withColumn("score", F.size(F.filter(F.transform("headers", _coerced), looks_like_data)))
        .withColumn(
            "revision",
            F.coalesce(
                F.regexp_extract(F.lower("table_name"), r"rev-(\d+)", 1).try_cast("int"),
                F.lit(-1),
            ),
        )
        .withColumn(
            "is_candidate",
            (F.col("row_count") > 0)
            & (F.col("non_empty_headers") >= F.greatest(F.lit(MIN_HEADERS), F.floor(width / 2)))
            & (F.col("score") >= F.greatest(F.lit(MIN_SCORE), F.floor(width / 5))),
        )
    )
    return scored.orderBy(*_best_first()).select(
        "position",
        "table_name",
        "row_count",
        "column_count",
        "non_empty_headers",
        "score",
        "revision",
        "is_candidate",
    )


def _best_first() -> list[Column]:
    best = ["is_candidate", "score", "revision", "row_count", "column_count"]
    return [*[F.desc(c) for c in best], F.asc("position")]


def primary_table(ranked: DataFrame) -> DataFrame:
    """The profile of the best table; the earlier one where two are equal."""
    return ranked.orderBy(*_best_first()).limit(1)
