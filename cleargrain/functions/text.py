"""Column expressions for text: missing tests, normalisation, accents, key serialisation."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that normalisation removes, and the one it turns into a space.
ZERO_WIDTH = "​‌‍﻿"
NO_BREAK_SPACE = "\xa0"

# Every character that Python's own strip() removes, found by rule.
WHITESPACE = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())

# The marker for a missing key part, and the default companion-column suffixes.
MISSING_KEY = "<MISSING>"
NORMALIZED_SUFFIX = "normalized_codex"
CLEANED_SUFFIX = "cleaned_codex"

_SPACES = "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE)
_WORD = r"\p{L}\p{N}"


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_missing(col: Column, dtype: T.DataType) -> Column:
    """NULL, or NaN for floating columns. Empty strings are values, not gaps."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a regex class."""
    spans: list[list[int]] = []
    for cp in points:
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in spans)


@lru_cache(maxsize=1)
def _combining_class() -> str:
    """Inside of a regex class of the characters with a non-zero canonical combining class.

    All of them are marks, so the class is "marks, minus the marks whose class is zero", plus those
    newer than the JVM's character tables. The block of common diacritics comes first, and the
    category tests settle nearly everything else.
    """
    points = range(sys.maxunicode + 1)
    combining = [cp for cp in points if unicodedata.combining(chr(cp))]
    spacing = [cp for cp in points if unicodedata.category(chr(cp))[0] == "M" and not unicodedata.combining(chr(cp))]
    common = _ranges([cp for cp in combining if cp < 0x370])
    return f"{common}[\\p{{M}}&&[^{_ranges(spacing)}]][\\p{{Cn}}&&[{_ranges(combining)}]]"


def _without(col: Column, characters: str, *, decompose: bool) -> Column:
    """Delete non-ASCII characters, after compatibility decomposition if wanted; ASCII text passes.

    Spark has no SQL function for decomposition, but ships ICU on every executor and can call a
    static method of it, which keeps the work in the JVM.
    """
    text = col
    if decompose:
        text = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), col, F.lit(True))
    return F.when(
        F.octet_length(col) > F.char_length(col), F.regexp_replace(text, f"[{characters}]+", "")
    ).otherwise(col)


def strip_accents(col: Column) -> Column:
    """Compatibility-decompose and drop combining marks."""
    return _without(col, _combining_class(), decompose=True)


def normalize(
    col: Column,
    *,
    uppercase: bool = True,
    remove_accents: bool = True,
    remove_punctuation: bool = True,
    collapse_whitespace: bool = True,
) -> Column:
    """Comparable form of a text value; NULL when nothing is left."""
    text = col.cast("string")
    if not collapse_whitespace:
        text = strip(F.replace(_without(text, ZERO_WIDTH, decompose=False), F.lit(NO_BREAK_SPACE), F.lit(" ")))
        text = strip_accents(text) if remove_accents else text
    elif remove_accents:
        # Zero-width characters survive decomposition unchanged, so they go with the marks.
        text = _without(text, ZERO_WIDTH + _combining_class(), decompose=True)
    else:
        text = _without(text, ZERO_WIDTH, decompose=False)
    if uppercase:
        text = F.upper(text)
    if remove_punctuation and collapse_whitespace:
        # Punctuation, underscores and white space all end up as one space: a single pass does it.
        text = F.btrim(F.regexp_replace(text, f"[^a-zA-Z0-9{_WORD}]+", " "))
    elif remove_punctuation:
        text = F.regexp_replace(text, f"[^{_WORD}_{_SPACES}]|_+", " ")
    elif collapse_whitespace:
        text = F.btrim(F.regexp_replace(text, f"[{_SPACES}]+", " "))
    return F.nullif(text, F.lit(""))


def companion_name(column: str, suffix: str) -> str:
    """Name of a derived column, leaving the original's untouched."""
    return f"{column}_{suffix.strip().replace(' ', '_')}"


def with_normalized(table: DataFrame, *columns: str, suffix: str = NORMALIZED_SUFFIX, **options) -> DataFrame:
    """Add a normalised companion for each column, in one projection."""
    absent = [name for name in columns if name not in table.columns]
    if absent:
        raise KeyError(f"no such column: {', '.join(absent)}")
    return table.withColumns(
        {companion_name(name, suffix): normalize(quoted(name), **options) for name in columns}
    )


def quoted(name: str) -> Column:
    """Reference a column whose name may hold characters such as ``#`` or a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def _float_text(col: Column) -> Column:
    """Shortest decimal text of a double, plain between 1e-4 and 1e16, else with an exponent."""
    printed = col.cast("string")
    plain = F.when(F.abs(col) >= 1, col.cast("decimal(38,12)")).otherwise(col.cast("decimal(38,24)"))
    plain = F.regexp_replace(plain.cast("string"), "(\\.\\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(printed, "E", 1), "\\.0$", "")
    power = F.regexp_replace(F.substring_index(printed, "E", -1), "^-?", "")
    sign = F.when(printed.contains("E-"), "-").otherwise("+")
    return (
        F.when(~printed.contains("E"), F.regexp_replace(F.lower(printed), "^(-?)infinity$", "$1inf"))
        .when((F.abs(col) >= 1e-4) & (F.abs(col) < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, F.lpad(power, 2, "0")))
    )


def display(col: Column, dtype: T.DataType, *, date_separator: str = " ") -> Column:
    """Text of a value as the reports print it."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        stamp = col.cast("timestamp_ntz")
        whole = F.date_format(stamp, f"yyyy-MM-dd'{date_separator}'HH:mm:ss")
        fraction = F.date_format(stamp, "SSSSSS")
        # Whole seconds of years of four digits, as nearly all are, print as Spark casts them, which is faster; year 0 does not.
        plain = stamp.cast("string")
        usual = (F.char_length(plain) == 19) & (plain >= "0001")
        return (
            F.when(usual, F.replace(plain, F.lit(" "), F.lit(date_separator)))
            .when(fraction == "000000", whole)
            .otherwise(F.concat_ws(".", whole, fraction))
        )
    if isinstance(dtype, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(dtype, T.FloatType):
        return _float_text(col.cast("string").cast("double"))
    if isinstance(dtype, T.DoubleType):
        return _float_text(col)
    return col.cast("string")


def serialize(col: Column, dtype: T.DataType) -> Column:
    """Stable text of a value for grouping keys."""
    text = strip(display(col, dtype, date_separator="T"))
    return F.when(is_missing(col, dtype), F.lit(MISSING_KEY)).otherwise(text)


def clean_string(col: Column) -> Column:
    """Trimmed text, with NULL as the empty string."""
    return F.coalesce(strip(col.cast("string")), F.lit(""))


def contains_ignoring_case(col: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test; NULL never matches."""
    return F.coalesce(F.contains(F.upper(col.cast("string")), F.upper(F.lit(needle))), F.lit(False))


def equals_ignoring_case(col: Column, wanted: str) -> Column:
    """Case-folded equality; NULL counts as the empty string."""
    folded = F.lower(F.upper(F.coalesce(col.cast("string"), F.lit(""))))
    return folded == F.lower(F.upper(F.lit(wanted)))
