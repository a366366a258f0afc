"""Filtered analytics and text search over the cleaned table."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_string, contains_ignoring_case, equals_ignoring_case, quoted
from ..functions.values import is_known_region, percent, start_year, to_number
from .cleaning import cleaned_table
from .profile import ROW_ID
from .roles import DEFAULT_ROLES, Roles, display_columns
from .summary import accepted_ratio, bars, facts, largest_duplicate_groups, status_counts

# How many rows and labels each view shows.
PREVIEW_ROWS = 8
TOP_LABELS = 8
OWNER_OPTIONS = 30
SEARCH_ROWS = 75
BLANK_SEARCH_ROWS = 30

OWNER, REGION, YEAR = "owner", "region", "year"


@dataclass(frozen=True)
class Lens:
    """A slice of the cleaned table; blank parts do not filter."""

    search: str = ""
    region: str = ""
    owner: str = ""
    year: str = ""

    def trimmed(self) -> "Lens":
        return Lens(self.search.strip(), self.region.strip(), self.owner.strip(), self.year.strip())

    @property
    def active(self) -> bool:
        return self.trimmed() != Lens()


def search_scopes(headers: list[str], roles: Roles = DEFAULT_ROLES) -> dict[str, list[str]]:
    """Columns looked at in each search scope."""
    scopes = {
        "all": (roles.reference, roles.recipient, roles.recipient_cleaned, roles.owner_title, roles.titles[0]),
        "reference": (roles.reference,),
        "recipient": (roles.recipient, roles.recipient_cleaned),
        "organization": (roles.owner_title,),
        "agreement": (roles.titles[0],),
    }
    return {scope: [c for c in columns if c in headers] for scope, columns in scopes.items()}


def _any_contains(columns: list[str], needle: str) -> Column:
    return reduce(lambda a, b: a | b, [contains_ignoring_case(quoted(c), needle) for c in columns], F.lit(False))


def lens_predicate(table: DataFrame, lens: Lens, roles: Roles = DEFAULT_ROLES) -> Column:
    """Whether a row is in the slice."""
    lens = lens.trimmed()
    tests = []
    if lens.search:
        tests.append(_any_contains(search_scopes(table.columns, roles)["all"], lens.search))
    if lens.region:
        tests.append(equals_ignoring_case(quoted(roles.region), lens.region))
    if lens.owner:
        tests.append(equals_ignoring_case(quoted(roles.owner_title), lens.owner))
    if lens.year:
        dated = isinstance(table.schema[roles.start].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        if dated and re.fullmatch(r"[1-9]\d{3}", lens.year) and lens.year != "9999":
            # A range on the column itself, by which files and row groups can be skipped.
            tests.append(quoted(roles.start) >= F.lit(f"{lens.year}-01-01").cast(table.schema[roles.start].dataType))
            tests.append(quoted(roles.start) < F.lit(f"{int(lens.year) + 1}-01-01").cast(table.schema[roles.start].dataType))
        tests.append(F.coalesce(F.substring(quoted(roles.start).cast("string"), 1, 4) == lens.year, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def lens_filter(table: DataFrame, lens: Lens, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows of the slice."""
    return table.filter(lens_predicate(table, lens, roles))


def cleaned_slice(table: DataFrame, mapping: DataFrame, lens: Lens, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows of the slice of the cleaned table.

    Region, owner and year are columns of the source: their tests come before the names are
    normalised and cleaned, and so reach the scan. Only the search looks at cleaned names.
    """
    rows = lens_filter(table, replace(lens, search=""), roles)
    return lens_filter(cleaned_table(rows, mapping, roles), Lens(search=lens.search), roles)


def preferred_recipient(roles: Roles = DEFAULT_ROLES) -> Column:
    """The cleaned recipient name where there is one, else the raw one; NULL when both are blank."""
    cleaned, raw = clean_string(quoted(roles.recipient_cleaned)), clean_string(quoted(roles.recipient))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.nullif(raw, F.lit("")))


def key_figures(table: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Record count, total and mean value, and exact distinct recipients and owners."""
    value = to_number(quoted(roles.value))
    return table.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_value"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("average_value"),
        F.count_distinct(preferred_recipient(roles)).alias("unique_recipients"),
        F.count_distinct(F.nullif(clean_string(quoted(roles.owner_title)), F.lit(""))).alias("unique_owners"),
    )


def facets(table: DataFrame, *, row_id: str = ROW_ID, strip_dates: bool = True, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Count, value total and first row of every owner, region and start year.

    One scan and one exchange of partial sums serve every chart and filter list.
    """
    start = quoted(roles.start)
    labelled = table.select(
        F.col(row_id).alias("at"),
        F.coalesce(to_number(quoted(roles.value)), F.lit(0.0)).alias("amount"),
        clean_string(quoted(roles.owner_title)).alias(OWNER),
        clean_string(quoted(roles.region)).alias(REGION),
        start_year(clean_string(start) if strip_dates else start).alias(YEAR),
    )
    return (
        labelled.unpivot(["at", "amount"], [OWNER, REGION, YEAR], "facet", "label")
        .filter(F.col("label") != "")
        .groupBy("facet", "label")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum("amount").alias("total_value"),
            F.min("at").alias("first_row"),
        )
    )


def _most_common() -> list[Column]:
    """Most frequent first, then the label met first."""
    return [F.desc("records"), F.asc("first_row")]


def filter_options(
    table: DataFrame, *, owners_shown: int | None = OWNER_OPTIONS, row_id: str = ROW_ID, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Labels offered as filters: known regions by name, the top owners, years from the latest."""
    counted = facets(table, row_id=row_id, strip_dates=False, roles=roles)
    owners = counted.filter(F.col("facet") == OWNER)
    if owners_shown is not None:
        owners = owners.orderBy(*_most_common()).limit(owners_shown)
    regions = counted.filter((F.col("facet") == REGION) & is_known_region(F.col("label")))
    years = counted.filter(F.col("facet") == YEAR)
    # What is numbered here is at most the owners shown, 14 regions and the four-digit years.
    numbered = [
        part.withColumn("position", F.row_number().over(Window.partitionBy("facet").orderBy(*order)))
        for part, order in (
            (owners, _most_common()),
            (regions, [F.asc("label")]),
            (years, [F.desc("label")]),
        )
    ]
    return reduce(DataFrame.unionByName, numbered).select("facet", "position", "label")


def label_chart(counted: DataFrame, facet: str, n: int = TOP_LABELS) -> DataFrame:
    """Most common labels of a facet with their share of all labelled rows."""
    labels = counted.filter(F.col("facet") == facet)
    total = labels.agg(F.sum("records").alias("total")).scalar()
    return (
        labels.orderBy(*_most_common())
        .limit(n)
        .select("label", F.col("records").alias("value"), percent(F.col("records"), total).alias("share"))
    )


def label_values(counted: DataFrame, facet: str, n: int = TOP_LABELS) -> DataFrame:
    """Most common labels of a facet with their value totals."""
    return (
        counted.filter(F.col("facet") == facet).orderBy(*_most_common()).limit(n).select("label", "records", "total_value")
    )


def year_chart(counted: DataFrame, n: int = TOP_LABELS) -> DataFrame:
    """The most recent years, oldest of them first."""
    recent = counted.filter(F.col("facet") == YEAR).orderBy(F.desc("label")).limit(n)
    return recent.orderBy("label").select(F.col("label").alias("year"), "records", "total_value")


def preview(table: DataFrame, *, n: int = PREVIEW_ROWS, row_id: str = ROW_ID, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The first rows of the slice in scan order."""
    return table.orderBy(row_id).limit(n).select(*[quoted(c) for c in roles.preview if c in table.columns])


def preview_status(table: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """Whether the slice is empty, or larger than its preview."""
    count = F.col("record_count")
    return table.agg(F.count(F.lit(1)).alias("record_count")).select(
        "record_count", (count > n).alias("truncated"), (count == 0).alias("empty")
    )


def leaders(
    table: DataFrame,
    *,
    counted: DataFrame | None = None,
    records: int | None = None,
    row_id: str = ROW_ID,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """The most common owner, region and year, and their share of the slice's records.

    Facets and the number of records that are known already need not be found again.
    """
    total = F.lit(records) if records is not None else table.agg(F.count(F.lit(1)).alias("n")).scalar()
    best = (
        (facets(table, row_id=row_id, roles=roles) if counted is None else counted)
        .groupBy("facet")
        .agg(F.max(F.struct("records", (-F.col("first_row")).alias("earliest"), "label", "total_value")).alias("top"))
    )
    return best.select(
        "facet",
        F.col("top.label").alias("label"),
        F.col("top.records").alias("records"),
        F.col("top.total_value").alias("total_value"),
        percent(F.col("top.records"), total).alias("share"),
    )


def compare_to_whole(table: DataFrame, lens: Lens, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Share of records and of value that the slice holds, from one pass over the table."""
    inside = lens_predicate(table, lens, roles)
    value = F.coalesce(to_number(quoted(roles.value)), F.lit(0.0))
    sums = table.agg(
        F.count_if(inside).alias("slice_records"),
        F.count(F.lit(1)).alias("all_records"),
        F.coalesce(F.sum(F.when(inside, value)), F.lit(0.0)).alias("slice_value"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("all_value"),
    )
    return sums.select(
        "*",
        percent(F.col("slice_records"), F.greatest("all_records", F.lit(1))).alias("record_share"),
        percent(F.col("slice_value"), F.greatest("all_value", F.lit(1.0))).alias("value_share"),
    )


def insights(missing: DataFrame, duplicates: DataFrame, variants: DataFrame, top: DataFrame) -> DataFrame:
    """Highest missing column, largest duplicate group, mapping rate and strongest year."""
    year = top.filter(F.col("facet") == YEAR)
    return reduce(
        DataFrame.unionByName,
        [
            facts("highest_missing", bars(missing, "column_name", "missing_percentage", 1), "label", "value"),
            facts("largest_duplicate", largest_duplicate_groups(duplicates, 1), "duplicate_key", "occurrences"),
            facts("mapping_rate", accepted_ratio(variants), None, "accepted_ratio"),
            facts("strongest_year", year, "label", "records"),
            facts("strongest_year_value", year, "label", "total_value"),
        ],
    )


def headline_counts(
    table_size: DataFrame, cleaned: DataFrame, missing: DataFrame, duplicates: DataFrame, mapping: DataFrame, row_id: str = ROW_ID
) -> DataFrame:
    """The counts at the top of the overview, one row each."""
    statuses = status_counts(mapping)
    groups = duplicates.agg(F.count(F.lit(1)).alias("duplicate_groups"))
    sparse = missing.agg(F.count_if(F.col("recommendation") == "Possible Removal").alias("high_missing_columns"))
    width = len([c for c in cleaned.columns if c != row_id])
    return reduce(
        DataFrame.unionByName,
        [
            facts("headline", table_size, None, "row_count"),
            facts("headline", table_size, None, "column_count"),
            facts("headline", statuses, None, "accepted_count"),
            facts("headline", statuses, None, "review_count"),
            facts("headline", groups, None, "duplicate_groups"),
            facts("headline", sparse, None, "high_missing_columns"),
            facts("headline", table_size.select(F.lit(width).alias("cleaned_columns")), None, "cleaned_columns"),
        ],
    )


def search(
    table: DataFrame,
    query: str = "",
    scope: str = "all",
    *,
    limit: int = SEARCH_ROWS,
    blank_limit: int = BLANK_SEARCH_ROWS,
    row_id: str = ROW_ID,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """First matching rows in scan order; a blank query shows the first rows of the table."""
    needle = query.strip()
    if not needle:
        return display_columns(table.orderBy(row_id).limit(blank_limit), roles)
    scopes = search_scopes(table.columns, roles)
    hits = table.filter(_any_contains(scopes.get(scope, scopes["all"]), needle))
    return display_columns(hits.orderBy(row_id).limit(limit), roles)


def search_status(results: DataFrame, query: str, limit: int = SEARCH_ROWS) -> DataFrame:
    """Number of rows returned and whether the search stopped at its limit."""
    count = F.col("result_count")
    blank = F.lit(not query.strip())
    return results.agg(F.count(F.lit(1)).alias("result_count")).select(
        "result_count", (~blank & (count >= limit)).alias("truncated")
    )
