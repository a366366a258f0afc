import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
SHARED = "the quick brown fox jumps over the lazy dog while nobody is looking at all " * 8
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        *[T.StructField(n, T.StringType()) for n in ("key", "fp", "h", "node", "size", "score", "start", "row", "bucket", "target", "id")],
    ]
)
TEXTS = [
    (1, SHARED + "first end", "en", "a"),
    (2, "other start " + SHARED, "en", "a"),
    (3, SHARED + "first end", "en", "b"),  # equal text, other id
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \t\n ", "fr", None),
    (7, "one two", "fr", None),
    (8, "ONE two", "fr", "c"),
    (9, LONG, "en", "c"),
    (10, "äöü ß 漢字 \U0001f600 naïve", "de", "c"),
    (11, "a" * 1_500, "en", "c"),
    (12, "idiot! you are a moron. fine weather today", "en", "c"),
    (13, LONG + " tail", "en", "d"),
    (14, "12 34 !!! ...", "en", "d"),
]
ROWS = [(d, t, lang, s, len(t or ""), *["x"] * 11) for d, t, lang, s in TEXTS]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, copies, a repeated row and clashing column names."""
    return spark.createDataFrame([*ROWS, ROWS[1]], DOCUMENTS)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOCUMENTS)
