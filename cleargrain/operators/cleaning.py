"""The audit mapping, and its application to the source table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CLEANED_SUFFIX, companion_name, quoted, strip, with_normalized
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, settle
from .roles import DEFAULT_ROLES, Roles, organization_columns, require_primary_organization

# The two verdicts appended to a mapping's justification.
AUTOMATIC = "Automatic correction permitted."
MANUAL = "Manual review required before correction."

# A name with more rows than this is dealt into parts where both sides of the lookup are exchanged.
HOT_ROWS = 1_000_000

MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("original_value", T.StringType()),
        T.StructField("cleaned_value", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("justification", T.StringType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("source_column", T.StringType()),
    ]
)


def cleaning_mapping(variants: DataFrame) -> DataFrame:
    """Auditable mapping from variant to canonical name."""
    verdict = F.when(F.col("status") == "accepted", AUTOMATIC).otherwise(MANUAL)
    return variants.select(
        F.col("variant_value").alias("original_value"),
        F.col("canonical_value").alias("cleaned_value"),
        "status",
        F.concat(
            "match_basis", F.lit(" with similarity score "), F.col("similarity_score").cast("string"), F.lit(". "), verdict
        ).alias("justification"),
        "similarity_score",
        "source_column",
    ).orderBy("status", F.desc("similarity_score"), "original_value")


def accepted_mapping(mapping: DataFrame) -> DataFrame:
    """Accepted corrections only, one per trimmed original; the last of the mapping's order wins."""
    return (
        mapping.filter(F.col("status") == "accepted")
        .groupBy(strip(F.col("original_value")).alias("original_value"))
        .agg(
            F.max_by(
                strip(F.col("cleaned_value")), F.struct(-F.col("similarity_score"), F.col("original_value"))
            ).alias("cleaned_value")
        )
    )


def with_normalized_organizations(table: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Normalised companions of all organization columns."""
    return with_normalized(table, *organization_columns(table.columns, roles))


def hot_names(names: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the names with more than ``hot_rows`` rows, and into how many parts of so many rows each goes.

    Takes a table with one column ``_name``; only 8-byte hashes are counted and exchanged. Two names of
    one hash share their parts, which changes no result. At most BROADCAST_ROWS hashes come back, those
    of the most rows, so the table can be broadcast; names beyond that are one part each. The result is stored.
    """
    counted = names.filter("_name IS NOT NULL").groupBy(F.xxhash64("_name").alias("_hash")).agg(F.count(F.lit(1)).alias("n"))
    most = counted.filter(F.col("n") > hot_rows).orderBy(F.desc("n"), "_hash").limit(BROADCAST_ROWS)
    return settle(most.select("_hash", F.ceil(F.col("n") / hot_rows).alias("_parts")))


def apply_mapping(
    table: DataFrame,
    mapping: DataFrame,
    column: str,
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    spread: int = 1024,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the cleaned companion of a column: its accepted correction, else the value as it was.

    One hop only, no row added or lost. The mapping is broadcast when its counted rows and bytes
    allow. Beyond that both sides are exchanged. Names are counted first: a name with more than
    ``hot_rows`` rows is dealt into parts of about so many, each of which meets a copy of the mapping's
    row; other names are one part, with one row of the mapping. Rows without a name, which match
    nothing, are spread over ``spread`` parts.
    """
    lookup, small = broadcast_if_small(
        accepted_mapping(mapping).select(F.col("original_value").alias("_original"), F.col("cleaned_value").alias("_cleaned")),
        broadcast_rows,
        broadcast_bytes,
    )
    value = quoted(column)
    name = strip(value.cast("string"))
    keyed = table.withColumn("_name", name)
    match = F.col("_name") == F.col("_original")
    if not small:
        hot = F.broadcast(hot_names(table.select(name.alias("_name")), hot_rows))
        parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
        others = [quoted(c) for c in table.columns if c != column] or [F.rand(seed=0)]
        dealt = F.pmod(F.xxhash64(*others), F.when(value.isNull(), F.lit(spread).cast("bigint")).otherwise(parts))
        keyed = keyed.withColumn("_hash", F.xxhash64("_name")).join(hot, "_hash", "left").withColumn("_part", dealt)
        lookup = lookup.withColumn("_hash", F.xxhash64("_original")).join(hot, "_hash", "left")
        every = F.sequence(F.lit(0).cast("bigint"), parts - 1)
        lookup = lookup.select("_original", "_cleaned", F.explode(every).alias("_lookup_part"))
        match &= F.col("_part") == F.col("_lookup_part")
    cleaned = companion_name(column, CLEANED_SUFFIX)
    return keyed.join(lookup, match, "left").select(
        *[quoted(c) for c in table.columns],
        F.coalesce("_cleaned", value.cast("string")).alias(cleaned),
    )


def cleaned_table(table: DataFrame, mapping: DataFrame, roles: Roles = DEFAULT_ROLES, **options) -> DataFrame:
    """All source columns, the normalised companions and the cleaned primary name."""
    column = require_primary_organization(table.columns, roles)
    return apply_mapping(with_normalized_organizations(table, roles), mapping, column, **options)
