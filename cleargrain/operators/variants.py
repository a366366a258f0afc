"""Spelling variants of organization names: exact after normalisation, or close within a block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize, quoted, strip
from ..functions.values import ScoreBands, score_status
from .closeness import best_pairs, close_pairs
from .roles import DEFAULT_ROLES, Roles, require_primary_organization

# Labels of the two ways to match, and the shape of the blocking keys.
EXACT_BASIS = "exact_normalized_match"
FUZZY_BASIS = "fuzzy_blocked_match"
EXACT_REASON = "Values become identical after deterministic text normalization."
FUZZY_REASON = "RapidFuzz WRatio on normalized organization names within the same block."
PREFIX_LENGTH, TOKEN_LENGTH, INITIALS, LENGTH_STEP = 6, 8, 4, 5
# A block is cut into parts of about this many names; each two parts are compared by a task of their own.
PART_NAMES = 512

MATCH_SCHEMA = T.StructType(
    [
        T.StructField("variant_value", T.StringType()),
        T.StructField("canonical_value", T.StringType()),
        T.StructField("normalized_variant", T.StringType()),
        T.StructField("normalized_canonical", T.StringType()),
        T.StructField("variant_count", T.LongType()),
        T.StructField("canonical_count", T.LongType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("match_basis", T.StringType()),
        T.StructField("justification", T.StringType()),
    ]
)
VARIANT_SCHEMA = T.StructType([T.StructField("source_column", T.StringType()), *MATCH_SCHEMA.fields])


def value_counts(table: DataFrame, column: str | Column, normalized: str | Column | None = None) -> DataFrame:
    """Rows per distinct trimmed value, with its normalised form.

    Values are counted before they are normalised, so normalisation runs once per distinct value.
    A ready-made normalised column can be passed instead.
    """
    original = strip((quoted(column) if isinstance(column, str) else column).cast("string"))
    named = table.select(
        original.alias("original_value"),
        *(
            [strip((quoted(normalized) if isinstance(normalized, str) else normalized).cast("string")).alias("normalized_value")]
            if normalized is not None
            else []
        ),
    ).filter(F.col("original_value") != "")
    counts = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("frequency"))
    if normalized is None:
        counts = counts.withColumn("normalized_value", normalize(F.col("original_value")))
    return counts.filter(F.col("normalized_value") != "").select("original_value", "normalized_value", "frequency")


def _weight(original: str = "original_value", frequency: str = "frequency") -> Column:
    """What makes a spelling the preferred one: use, then length, then alphabet."""
    return F.struct(
        F.col(frequency).alias("frequency"),
        F.char_length(original).alias("length"),
        F.col(original).alias("original_value"),
    )


def canonical_values(counts: DataFrame) -> DataFrame:
    """The preferred spelling of each normalised value."""
    return (
        counts.groupBy("normalized_value")
        .agg(F.max(_weight()).alias("top"), F.count(F.lit(1)).alias("spellings"))
        .select(
            "normalized_value",
            F.col("top.original_value").alias("canonical_value"),
            F.col("top.frequency").alias("canonical_count"),
            "spellings",
        )
    )


def exact_matches(counts: DataFrame) -> DataFrame:
    """Every other spelling of a normalised value, mapped to the preferred one.

    The preferred spelling is aggregated and joined back, not ranked in a window, so that one value
    with very many spellings is combined early and its join partition can be split.
    """
    preferred = canonical_values(counts).filter("spellings > 1")
    return (
        counts.join(preferred, "normalized_value")
        .filter(F.col("original_value") != F.col("canonical_value"))
        .select(
            F.col("original_value").alias("variant_value"),
            "canonical_value",
            F.col("normalized_value").alias("normalized_variant"),
            F.col("normalized_value").alias("normalized_canonical"),
            F.col("frequency").alias("variant_count"),
            "canonical_count",
            F.lit(100.0).alias("similarity_score"),
            F.lit("accepted").alias("status"),
            F.lit(EXACT_BASIS).alias("match_basis"),
            F.lit(EXACT_REASON).alias("justification"),
        )
    )


def representatives(counts: DataFrame) -> DataFrame:
    """One spelling per normalised value stands for it in fuzzy matching."""
    return canonical_values(counts).select(
        "normalized_value",
        F.col("canonical_value").alias("original_value"),
        F.col("canonical_count").alias("frequency"),
    )


def block_keys(normalized: Column) -> Column:
    """The three keys under which close spellings meet, all tied to the length without spaces."""
    compact = F.replace(normalized, F.lit(" "), F.lit(""))
    bucket = F.floor(F.char_length(compact) / LENGTH_STEP).cast("string")
    first = F.substring_index(normalized, " ", 1)
    initials = F.regexp_replace(F.substring_index(normalized, " ", INITIALS), r"(\S)\S* ?", "$1")
    return F.array(
        F.concat(F.lit("prefix:"), F.substring(compact, 1, PREFIX_LENGTH), F.lit(":"), bucket),
        F.concat(F.lit("token:"), F.substring(first, 1, TOKEN_LENGTH), F.lit(":"), bucket),
        F.concat(F.lit("initials:"), initials, F.lit(":"), bucket),
    )


def block_members(names: DataFrame) -> DataFrame:
    """Each representative under each of its blocking keys."""
    return names.withColumn("block", F.explode(block_keys(F.col("normalized_value"))))


def _with_parts(members: DataFrame) -> DataFrame:
    """Members of blocks of two or more, with the number of parts of the block and the name's own part."""
    sizes = members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART_NAMES).alias("parts"), F.count(F.lit(1)).alias("size"))
    return (
        members.join(sizes.filter("size > 1").drop("size"), "block")
        .withColumn("part", F.pmod(F.xxhash64("normalized_value"), F.col("parts")))
    )


def _other_parts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Distinct unordered pairs of normalised names that share a block: all of them, by definition.

    A pair counts only in the first of its names' keys that it shares: no pair has to be exchanged
    to find that it was already seen. Both sides of a large block are dealt into parts, and each two
    parts meet in a group of their own. Matches are found without this list.
    """
    named = _with_parts(members).select("block", "part", "parts", "normalized_value", F.array_sort(block_keys(F.col("normalized_value"))).alias("blocks"))
    left = named.select("*", F.col("part").alias("i"), _other_parts().alias("j")).alias("l")
    right = named.select("*", F.col("part").alias("j"), _other_parts().alias("i")).alias("r")
    met = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("block", "i", "j")]
    first_shared = F.array_min(F.array_intersect("l.blocks", "r.blocks"))
    ordered = F.col("l.normalized_value") < F.col("r.normalized_value")
    return left.join(right, reduce(lambda a, b: a & b, met) & ordered & (F.col("l.block") == first_shared)).select(
        F.col("l.normalized_value").alias("left_value"), F.col("r.normalized_value").alias("right_value")
    )


def scored_pairs(names: DataFrame, min_similarity: float = 80.0, metric: str = "weighted") -> DataFrame:
    """Pairs of representatives of a block at or above the minimum similarity, with both names' spelling and count."""
    return close_pairs(names, block_keys, min_similarity, metric)


def strongest_pairs(names: DataFrame, min_similarity: float = 80.0) -> DataFrame:
    """For each representative its best pair with a preferred name of a block."""
    return best_pairs(names, block_keys, _weight, min_similarity)


def directed_matches(scored: DataFrame, bands: ScoreBands = ScoreBands()) -> DataFrame:
    """Point each pair from the weaker spelling to the preferred one."""
    left = _weight("left_original_value", "left_frequency")
    right = _weight("right_original_value", "right_frequency")

    def pick(name: str, canonical: bool) -> Column:
        winner, loser = F.col(f"left_{name}"), F.col(f"right_{name}")
        return F.when(left > right, winner if canonical else loser).otherwise(loser if canonical else winner)

    # One spelling with two ready-made forms is no variant of itself.
    return scored.filter(F.col("left_original_value") != F.col("right_original_value")).select(
        pick("original_value", False).alias("variant_value"),
        pick("original_value", True).alias("canonical_value"),
        pick("normalized_value", False).alias("normalized_variant"),
        pick("normalized_value", True).alias("normalized_canonical"),
        pick("frequency", False).alias("variant_count"),
        pick("frequency", True).alias("canonical_count"),
        F.bround("score", 2).alias("similarity_score"),
        score_status(F.col("score"), bands).alias("status"),
        F.lit(FUZZY_BASIS).alias("match_basis"),
        F.lit(FUZZY_REASON).alias("justification"),
    )


def fuzzy_matches(
    counts: DataFrame, bands: ScoreBands = ScoreBands(), *, min_similarity: float | None = None, metric: str = "weighted"
) -> DataFrame:
    """Close spellings found within blocks: all of them, as pairs from variant to preferred name."""
    floor = bands.review if min_similarity is None else min_similarity
    return directed_matches(scored_pairs(representatives(counts), floor, metric), bands)


def strongest_fuzzy_matches(
    counts: DataFrame, bands: ScoreBands = ScoreBands(), *, min_similarity: float | None = None, metric: str = "weighted"
) -> DataFrame:
    """The best close spelling of each variant, without listing the others."""
    floor = bands.review if min_similarity is None else min_similarity
    if metric != "weighted":
        return strongest_matches(fuzzy_matches(counts, bands, min_similarity=floor, metric=metric))
    return strongest_matches(directed_matches(strongest_pairs(representatives(counts), floor), bands))


def strongest_matches(matches: DataFrame) -> DataFrame:
    """One mapping per variant: best score, then most used, then first canonical name."""
    best_first = Window.partitionBy("variant_value").orderBy(
        F.desc("similarity_score"), F.desc("canonical_count"), F.asc("canonical_value")
    )
    return matches.withColumn("place", F.row_number().over(best_first)).filter("place = 1").drop("place")


def matched_variants(counts: DataFrame, bands: ScoreBands = ScoreBands(), *, one_form: bool = True, **options) -> DataFrame:
    """All variants of counted values, each mapped once.

    Where a value has one normalised form, an exact variant is never its value's representative and
    only representatives are matched fuzzily, so just the fuzzy matches can compete for a variant.
    With ready-made forms (``one_form=False``) one value can have several, and all its matches compete.
    """
    found = exact_matches(counts).unionByName(strongest_fuzzy_matches(counts, bands, **options))
    return found if one_form else strongest_matches(found)


def report_order() -> list[Column]:
    return [
        F.asc("status"),
        F.desc("similarity_score"),
        F.desc("canonical_count"),
        F.desc("variant_count"),
        F.asc("variant_value"),
    ]


def variant_report(
    table: DataFrame,
    column: str | None = None,
    *,
    normalized: str | None = None,
    bands: ScoreBands = ScoreBands(),
    roles: Roles = DEFAULT_ROLES,
    **options,
) -> DataFrame:
    """Review-ready list of variants of one organization column, by default the primary one."""
    column = column or require_primary_organization(table.columns, roles)
    counts = value_counts(table, column, normalized)
    found = matched_variants(counts, bands, one_form=normalized is None, **options).withColumn("source_column", F.lit(column))
    return found.select(*VARIANT_SCHEMA.names).orderBy(*report_order())
