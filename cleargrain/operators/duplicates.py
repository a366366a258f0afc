"""Groups of rows that repeat: exactly, by identifier, or by the same business facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MISSING_KEY, is_missing, normalize, quoted, serialize, strip
from ..session import broadcast_if_small
from .profile import ROW_ID
from .roles import DEFAULT_ROLES, Roles, primary_organization

# The rule names, group types and recommendations of the report.
EXACT_RULE = "all_columns_except_row_number"
PROBABLE_RULE = "organization_title_value_date_owner"
EXACT, IDENTIFIER, PROBABLE = "exact_duplicate", "identifier_duplicate", "probable_duplicate"
RECOMMENDATIONS = {
    EXACT: "Confirm whether the repeated rows are redundant records.",
    IDENTIFIER: "Review whether repeated identifiers represent true duplicates or legitimate amendments.",
    PROBABLE: "Manual review required because similarity on business fields does not prove redundancy.",
}
EXACT_KEY_PARTS_SHOWN = 8
# So many repeated hashes of 8 bytes are broadcast.
HASHES_BROADCAST = 2_000_000
PROBABLE_PARTS_NEEDED = 4
PROBABLE_KEY = "_probable_key"
FULL_KEY = "full_key"

REPORT_COLUMNS = (
    "duplicate_type",
    "rule_name",
    "duplicate_key",
    "occurrences",
    "example_ref_number",
    "example_organization",
    "review_recommendation",
)


def _serialized(table: DataFrame, column: str | None) -> Column:
    if column is None or column not in table.columns:
        return F.lit(MISSING_KEY)
    return serialize(quoted(column), table.schema[column].dataType)


def _report(groups: DataFrame, *extra: str) -> DataFrame:
    recommendation = reduce(
        lambda chain, kind: chain.when(F.col("duplicate_type") == kind, RECOMMENDATIONS[kind]),
        RECOMMENDATIONS,
        F,
    )
    return groups.withColumn("review_recommendation", recommendation).select(*REPORT_COLUMNS, *extra)


def _comparable(table: DataFrame, column: str) -> Column:
    """A value that is equal exactly when the serialised value is, without rendering it."""
    col, dtype = quoted(column), table.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return F.coalesce(strip(col), F.lit(MISSING_KEY))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~is_missing(col, dtype), col.cast("string"))
    return col


def exact_duplicates(
    table: DataFrame,
    *,
    row_id: str = ROW_ID,
    roles: Roles = DEFAULT_ROLES,
    full_key: bool = False,
) -> DataFrame:
    """Rows equal in every column but the row number.

    A first pass, run at once, counts 8-byte hashes. Only rows whose hash repeats go on to be grouped by their full
    values, which also tells colliding rows apart. The repeated hashes are broadcast where they are few, so that
    no other row is exchanged, and joined by exchange otherwise. Values are rendered as text only for the
    groups found. The shown key has the first eight columns; ``full_key`` adds a hash of all of
    them, by which groups can be told apart and rows joined back.
    """
    columns = [c for c in table.columns if c not in (row_id, roles.row_number)]
    names = {column: f"k{i}" for i, column in enumerate(columns)}
    organization = primary_organization(table.columns, roles)
    rows = table.select(*[_comparable(table, column).alias(name) for column, name in names.items()])
    rows = rows.withColumn("h", F.xxhash64(*names.values()))

    repeated, _ = broadcast_if_small(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), HASHES_BROADCAST)
    rows = rows.join(repeated, "h", "left_semi")
    groups = rows.groupBy(*names.values()).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")

    def shown(column: str | None) -> Column:
        """Every row of a group agrees on the value, so any row is the first one."""
        if column not in names:
            return F.lit(MISSING_KEY)
        dtype = table.schema[column].dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return serialize(F.col(names[column]).cast(dtype), dtype)
        return serialize(F.col(names[column]), dtype)

    report = _report(
        groups.select(
            F.md5(F.concat_ws(" || ", *[shown(c) for c in columns])).alias(FULL_KEY),
            F.lit(EXACT).alias("duplicate_type"),
            F.lit(EXACT_RULE).alias("rule_name"),
            F.concat_ws(" || ", *[shown(c) for c in columns[:EXACT_KEY_PARTS_SHOWN]]).alias("duplicate_key"),
            "occurrences",
            shown(roles.reference).alias("example_ref_number"),
            shown(organization).alias("example_organization"),
        ),
        FULL_KEY,
    )
    return report if full_key else report.drop(FULL_KEY)


def with_probable_key(table: DataFrame, name: str = "probable_key", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Add the business facts of each row in one string; NULL when too few of them are known.

    The parts are a projection of their own, so each is computed once however often it is read.
    """
    organization = primary_organization(table.columns, roles)
    if organization is None:
        return table.withColumn(name, F.lit(None).cast("string"))
    titles = [quoted(c).cast("string") for c in roles.titles if c in table.columns]
    # An empty first title gives way to the second; a blank one does not.
    title = F.coalesce(*[F.nullif(c, F.lit("")) for c in titles]) if titles else F.lit(None)
    parts = {
        "_organization": normalize(quoted(organization)),
        "_title": F.coalesce(normalize(title), F.lit(MISSING_KEY)),
        **{f"_{c}": _serialized(table, c) for c in (roles.value, roles.start, roles.end, roles.owner)},
    }
    known = reduce(lambda a, b: a + b, [(F.col(part) != MISSING_KEY).cast("int") for part in parts])
    complete = F.col("_organization").isNotNull() & (known >= PROBABLE_PARTS_NEEDED)
    return (
        table.withColumns(parts)
        .withColumn(name, F.when(complete, F.concat_ws(" | ", *parts)))
        .drop(*parts)
    )


def _identifier_keys(table: DataFrame, roles: Roles) -> dict[str, Column]:
    keys = {}
    for column in roles.identifiers:
        if column in table.columns:
            missing = is_missing(quoted(column), table.schema[column].dataType)
            keys[column] = F.when(~missing, _serialized(table, column))
    return keys


def _keyed_groups(table: DataFrame, rules: dict[str, Column], row_id: str, roles: Roles) -> DataFrame:
    """Groups under several keys at once: one scan and one exchange for all the rules.

    The first row of a group is found by its number alone, so groups combine in hash maps before the
    exchange; its reference and organization are then joined back. Row numbers must be unique.
    """
    organization = primary_organization(table.columns, roles)
    keyed = table.select(F.col(row_id).alias("at"), *[key.alias(f"rule_{i}") for i, key in enumerate(rules.values())])
    shown = table.select(
        F.col(row_id).alias("first"),
        _serialized(table, roles.reference).alias("example_ref_number"),
        _serialized(table, organization).alias("example_organization"),
    )
    names = F.array(*[F.lit(rule) for rule in rules])
    return (
        keyed.unpivot(["at"], [f"rule_{i}" for i in range(len(rules))], "rule", "duplicate_key")
        .filter(F.col("duplicate_key").isNotNull())
        .groupBy("rule", "duplicate_key")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.min("at").alias("first"),
        )
        .filter("occurrences > 1")
        .join(shown, "first")
        .withColumn("rule_name", F.get(names, F.substring_index("rule", "_", -1).cast("int")))
        .select(
            F.when(F.col("rule_name") == PROBABLE_RULE, PROBABLE).otherwise(IDENTIFIER).alias("duplicate_type"),
            "rule_name",
            "duplicate_key",
            "occurrences",
            "example_ref_number",
            "example_organization",
        )
        .transform(_report)
    )


def identifier_duplicates(table: DataFrame, *, row_id: str = ROW_ID, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Identifiers carried by more than one row, for each identifier column."""
    return _keyed_groups(table, _identifier_keys(table, roles), row_id, roles)


def probable_duplicates(table: DataFrame, *, row_id: str = ROW_ID, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows that share their business facts."""
    keyed = with_probable_key(table, PROBABLE_KEY, roles)
    return _keyed_groups(keyed, {PROBABLE_RULE: F.col(PROBABLE_KEY)}, row_id, roles)


def duplicate_groups(table: DataFrame, *, row_id: str = ROW_ID, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """All duplicate groups, largest first within each type."""
    rules = {**_identifier_keys(table, roles), PROBABLE_RULE: F.col(PROBABLE_KEY)}
    keyed = with_probable_key(table, PROBABLE_KEY, roles)
    return (
        exact_duplicates(table, row_id=row_id, roles=roles)
        .unionByName(_keyed_groups(keyed, rules, row_id, roles))
        .orderBy("duplicate_type", F.desc("occurrences"), "rule_name", "duplicate_key")
    )
