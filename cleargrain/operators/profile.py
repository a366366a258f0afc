"""Column profiles and the missing-values report.

Every figure about every column comes from one pass whose sums are combined before any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import display, is_missing, quoted, strip
from ..functions.values import (
    TYPE_PRIORITY,
    MissingBands,
    declared_type,
    missing_recommendation,
    percent,
    value_type,
)
from ..session import settle

ROW_ID = "_row_id"


def _fields(table: DataFrame, row_id: str) -> list[T.StructField]:
    return [field for field in table.schema.fields if field.name != row_id]


def _reads_text(field: T.StructField, lexical: bool) -> bool:
    return lexical and isinstance(field.dataType, T.StringType)


def column_counts(table: DataFrame, *, row_id: str = ROW_ID, lexical: bool = False) -> DataFrame:
    """One row per column: totals, and count and first row of each coarse type."""
    fields = _fields(table, row_id)
    if any(_reads_text(field, lexical) for field in fields):
        return _tagged_counts(table, fields, row_id)
    return _declared_counts(table, fields)


def _declared_counts(table: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Typed columns only have gaps to count: one row of aggregates, turned into a table."""
    gaps = [F.count_if(is_missing(quoted(f.name), f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]

    def entry(place: int, field: T.StructField) -> Column:
        present = F.col("total") - F.col(f"m{place}")
        return _column_entry(
            F.lit(place),
            F.lit(field.name),
            F.col("total"),
            F.col(f"m{place}"),
            F.array(_type_entry(F.lit(declared_type(field.dataType)), present, F.lit(0).cast("bigint"))),
        )

    entries = F.array(*[entry(place, field) for place, field in enumerate(fields)])
    return table.agg(F.count(F.lit(1)).alias("total"), *gaps).select(F.inline(entries))


def _tagged_cells(table: DataFrame, fields: list[T.StructField], lexical: bool, kept: dict[str, Column]) -> DataFrame:
    """One row per cell with its column's place and its coarse type.

    Cells stream through one small classifier, which compiles far better than an expression per
    column and type. Only text that is to be read is looked at; other cells pass as present or missing.
    """
    cells = {
        f"c{i}": quoted(f.name) if _reads_text(f, lexical) else F.when(~is_missing(quoted(f.name), f.dataType), F.lit(""))
        for i, f in enumerate(fields)
    }
    # Stripped in a projection of its own, so once per cell.
    tag = value_type(F.col("value"), T.StringType(), lexical=True, stripped=F.col("text"))
    return (
        table.select(*[col.alias(name) for name, col in kept.items()], *[cell.alias(name) for name, cell in cells.items()])
        .unpivot(list(kept), list(cells), "cell", "value")
        .withColumn("text", strip(F.col("value")))
        .select("cell", tag.alias("tag"), *kept)
    )


def _typed(counted: DataFrame, fields: list[T.StructField], lexical: bool) -> DataFrame:
    """Tags of columns whose type is declared give way to it; cells get their column's place."""
    declared = F.array(*[F.lit(None if _reads_text(f, lexical) else declared_type(f.dataType)) for f in fields])
    ordinal, tag = F.substring("cell", 2, 9).cast("int"), F.col("tag")
    named = F.when(tag == "missing", tag).otherwise(F.coalesce(F.get(declared, ordinal), tag))
    return counted.withColumn("ordinal", ordinal).withColumn("tag", named).drop("cell")


def _tagged_counts(table: DataFrame, fields: list[T.StructField], row_id: str) -> DataFrame:
    """Text is classified value by value, into sums combined before the exchange."""
    names = F.array(*[F.lit(f.name) for f in fields])
    tag = F.col("tag")
    cells = _tagged_cells(table, fields, True, {"at": F.col(row_id)})
    counted = cells.groupBy("cell", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_row"))
    counted = _typed(counted, fields, True)
    present = F.when(tag != "missing", _type_entry(tag, F.col("n"), F.col("first_row")))
    per_column = counted.groupBy("ordinal").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(tag == "missing", F.col("n")).otherwise(0)).alias("missing"),
        # At most one entry per coarse type.
        F.collect_list(present).alias("types"),
    )
    entry = _column_entry(
        F.col("ordinal"), F.get(names, F.col("ordinal")), F.col("total"), F.col("missing"), F.col("types")
    )
    return per_column.select(F.inline(F.array(entry)))


def _column_entry(ordinal: Column, name: Column, total: Column, missing: Column, types: Column) -> Column:
    return F.struct(
        ordinal.alias("ordinal"),
        name.alias("column_name"),
        total.alias("total_rows"),
        missing.alias("missing_count"),
        types.alias("types"),
    )


def _type_entry(kind: Column, count: Column, first_row: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_PRIORITY]), kind)
    return F.struct(kind.alias("type"), rank.alias("rank"), count.alias("count"), first_row.alias("first_row"))


def inferred_type(*, first_seen: bool = False) -> Column:
    """Majority type from :func:`column_counts`.

    Ties go to the fixed priority, or to the type met first when ``first_seen`` is set.
    """
    tie = "first_row" if first_seen else "rank"
    ranked = F.transform(
        F.filter("types", lambda t: t["count"] > 0),
        lambda t: F.struct((-t["count"]).alias("n"), t[tie].alias("tie"), t["type"].alias("type")),
    )
    return F.coalesce(F.array_min(ranked)["type"], F.lit("unknown"))


def missing_values_report(
    table: DataFrame,
    *,
    row_id: str = ROW_ID,
    lexical: bool = False,
    bands: MissingBands = MissingBands(),
) -> DataFrame:
    """Missing counts, percentages and recommendations, worst column first."""
    counts = column_counts(table, row_id=row_id, lexical=lexical)
    return (
        counts.select(
            "column_name",
            inferred_type(first_seen=True).alias("inferred_type"),
            "total_rows",
            "missing_count",
            percent(F.col("missing_count"), F.col("total_rows")).alias("missing_percentage"),
        )
        .withColumn("recommendation", missing_recommendation(F.col("missing_percentage"), bands))
        .orderBy(F.desc("missing_percentage"), "column_name")
    )


def _counts_and_limits(table: DataFrame, n: int, row_id: str, lexical: bool) -> DataFrame:
    """One row per column: its counts as in :func:`column_counts`, and ``last``, a row id that bounds its first ``n`` values.

    One scan. Counts and the least row id are kept per column, type and each of a few hash buckets of
    the row id, combined before the exchange. Every one of these least ids is the place of another value,
    so at least ``n`` values do not exceed the nth least; a column with fewer buckets than that
    has its greatest id for a bound. The result, a row per column, is stored.
    """
    fields = _fields(table, row_id)
    bucket = F.pmod(F.xxhash64(F.col(row_id)), F.lit(64 * n))
    cells = _tagged_cells(table, fields, lexical, {"at": F.col(row_id), "bucket": bucket})
    held = cells.groupBy("cell", "tag", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_row"), F.max("at").alias("last_row")
    )
    # At most one entry per bucket.
    heads = F.slice(F.array_sort(F.collect_list("first_row")), 1, n)
    per_type = _typed(held, fields, lexical).groupBy("ordinal", "tag").agg(
        F.sum("n").alias("n"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), heads.alias("heads")
    )
    there = F.col("tag") != "missing"
    found = per_type.groupBy("ordinal").agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("missing_count"),
        F.collect_list(F.when(there, _type_entry(F.col("tag"), F.col("n"), F.col("first_row")))).alias("types"),
        F.get(F.array_sort(F.flatten(F.collect_list(F.when(there, F.col("heads"))))), F.lit(n - 1)).alias("nth"),
        F.max(F.when(there, F.col("last_row"))).alias("greatest"),
    )
    return settle(found.withColumn("last", F.coalesce("nth", "greatest")).drop("nth", "greatest"))


def _values_up_to(table: DataFrame, limits: dict[int, int | None], n: int, row_id: str) -> DataFrame:
    """The first ``n`` present values of each column, none of them behind the column's limit.

    The limits are numbers here, so files and row groups behind all of them are skipped.
    Only cells up to their column's limit are rendered and ranked.
    """
    at = F.col(row_id)
    values = []
    for i, f in enumerate(_fields(table, row_id)):
        limit = limits.get(i)
        near = F.lit(False) if limit is None else ~is_missing(quoted(f.name), f.dataType) & (at <= F.lit(limit))
        values.append(F.when(near, display(quoted(f.name), f.dataType)).alias(f"c{i}"))
    reached = [limit for limit in limits.values() if limit is not None]
    first = Window.partitionBy("cell").orderBy("at")
    heads = (
        table.filter(at <= F.lit(max(reached)) if reached else F.lit(False))
        .select(at.alias("at"), *values)
        .unpivot(["at"], [f"c{i}" for i in range(len(values))], "cell", "value")
        .filter(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= n)
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return (
        heads.groupBy("cell")
        .agg(F.array_join(F.transform(ordered, lambda e: e["value"]), ", ").alias("sample_values"))
        .select(F.substring("cell", 2, 9).cast("int").alias("ordinal"), "sample_values")
    )


def _limits(facts: DataFrame) -> dict[int, int | None]:
    """As many numbers as the table has columns."""
    return {r["ordinal"]: r["last"] for r in facts.select("ordinal", "last").collect()}


def first_values(table: DataFrame, *, n: int = 3, row_id: str = ROW_ID) -> DataFrame:
    """The first ``n`` present values of each column in row order, joined by commas.

    One scan bounds the row ids of these values per column; a second reads the rows up to the bounds.
    A column without values has no row.
    """
    return _values_up_to(table, _limits(_counts_and_limits(table, n, row_id, False)), n, row_id)


def column_profile(table: DataFrame, *, row_id: str = ROW_ID, lexical: bool = False, n: int = 3) -> DataFrame:
    """Type, fill and ``n`` sample values of each column, in column order.

    One scan of the whole table gives counts and bounds; a second stops at the bounds. A table without
    rows has columns of unknown type and no fill.
    """
    names = [(i, f.name) for i, f in enumerate(_fields(table, row_id))]
    facts = _counts_and_limits(table, n, row_id, lexical)
    samples = _values_up_to(table, _limits(facts), n, row_id)
    columns = table.sparkSession.createDataFrame(names, "ordinal int, column_name string")
    total, missing = (F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("total_rows", "missing_count"))
    return (
        # One row per column of the table on each side: as small as the header.
        columns.join(F.broadcast(facts), "ordinal", "left")
        .join(F.broadcast(samples), "ordinal", "left")
        .orderBy("ordinal")
        .select(
            "column_name",
            inferred_type().alias("inferred_type"),
            (total - missing).alias("non_null_count"),
            missing.alias("missing_count"),
            percent(missing, total).alias("missing_percentage"),
            F.coalesce("sample_values", F.lit("")).alias("sample_values"),
        )
    )


def top_missing(report: DataFrame, n: int = 10) -> DataFrame:
    """The columns with the highest missing percentage."""
    return report.orderBy(F.desc("missing_percentage"), "column_name").limit(n)


def columns_by_type(table: DataFrame, *, row_id: str = ROW_ID, lexical: bool = False) -> DataFrame:
    """Column names of each inferred type, in column order."""
    return (
        column_counts(table, row_id=row_id, lexical=lexical)
        .select("ordinal", "column_name", inferred_type().alias("inferred_type"))
        .groupBy("inferred_type")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("members"))
        .select(
            "inferred_type",
            F.size("members").alias("column_count"),
            F.array_join(F.transform("members", lambda m: m["column_name"]), ", ").alias("column_names"),
        )
    )


def table_facts(table: DataFrame, name: str, *, row_id: str = ROW_ID) -> DataFrame:
    """Row and column count of a table."""
    return table.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(_fields(table, row_id))).alias("column_count"),
    )


def removal_candidates(report: DataFrame) -> DataFrame:
    """Columns whose recommendation is removal."""
    return report.filter(F.col("recommendation") == "Possible Removal")
