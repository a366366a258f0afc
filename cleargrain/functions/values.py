"""Column expressions for coarse types, numbers, years and threshold bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import is_missing, strip

# The coarse types, most preferred first when a tie has to be broken.
TYPE_PRIORITY = ("date", "numeric", "text", "boolean", "other")

# The region labels offered as filters.
KNOWN_REGIONS = (
    "AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT", "Hors du Canada",
)

_TRUTH = r"^(?i:true|false)$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"^[+-]?(?i:inf|infinity)$"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


@dataclass(frozen=True)
class MissingBands:
    """Percentages that separate the handling recommendations."""

    simple_below: float = 5.0
    flag_up_to: float = 40.0
    evaluate_up_to: float = 70.0


@dataclass(frozen=True)
class ScoreBands:
    """Lowest scores for automatic acceptance and for manual review."""

    accepted: float = 95.0
    review: float = 80.0


def declared_type(dtype: T.DataType) -> str:
    """Coarse type of every present value in a column of this Spark type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "text"
    return "other"


def value_type(col: Column, dtype: T.DataType, *, lexical: bool = False, stripped: Column | None = None) -> Column:
    """Coarse type of each value, NULLs tagged ``missing``.

    A typed column needs no look at its values. Text that came from an untyped file can be
    classified by what it spells (``lexical=True``). It is read several times; ``stripped`` is a column of the
    stripped text, if there is one already.
    """
    kind: Column = F.lit(declared_type(dtype))
    if lexical and isinstance(dtype, T.StringType):
        text = strip(col) if stripped is None else stripped
        # What a pattern demands anyhow of the length or of one character is tested first, which spares most cells the pattern.
        kind = (
            F.when(F.char_length(text).between(4, 5) & text.rlike(_TRUTH), "boolean")
            .when((F.substring(text, 5, 1) == "-") & text.rlike(_ISO_DATE) & text.try_cast("timestamp_ntz").isNotNull(), "date")
            .when(F.substring(text, 1, 1).between("+", "9") & text.rlike(_NUMBER), "numeric")
            .otherwise("text")
        )
    return F.when(is_missing(col, dtype), "missing").otherwise(kind)


def is_type(col: Column, dtype: T.DataType, kind: str, *, lexical: bool = False) -> Column:
    """Whether each value is of one coarse type."""
    return value_type(col, dtype, lexical=lexical) == kind


def to_number(col: Column) -> Column:
    """Number in a text cell, NULL when it is not one."""
    text = strip(col.cast("string"))
    return F.when(text.rlike(_NUMBER) | text.rlike(_INFINITE), text.try_cast("double"))


def start_year(col: Column) -> Column:
    """First four characters of a date's text, NULL unless all are digits."""
    head = F.substring(col.cast("string"), 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head)


def is_known_region(col: Column) -> Column:
    return col.isin(*KNOWN_REGIONS)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to two places, ties to even; zero when there is nothing to divide by."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2), F.lit(0.0))


def missing_recommendation(pct: Column, bands: MissingBands = MissingBands()) -> Column:
    """Handling recommendation for a (rounded) missing percentage."""
    return (
        F.when(pct <= 0, "Nothing")
        .when(pct < bands.simple_below, "Simple Imputation")
        .when(pct <= bands.flag_up_to, "Imputation + Missing Flag")
        .when(pct <= bands.evaluate_up_to, "Evaluate Utility")
        .otherwise("Possible Removal")
    )


def score_status(score: Column, bands: ScoreBands = ScoreBands()) -> Column:
    """Decision for an unrounded similarity score."""
    return (
        F.when(score >= bands.accepted, "accepted")
        .when(score >= bands.review, "review")
        .otherwise("rejected")
    )
