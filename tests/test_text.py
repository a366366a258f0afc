"""Normalisation, accents and key serialisation against plain Python."""

import math
import re
import unicodedata
from datetime import datetime

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.functions import text


def python_normalize(value):
    """The rules spelled out one after the other."""
    value = re.sub("[​‌‍﻿]", "", value).replace("\xa0", " ").strip()
    value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).upper()
    value = re.sub(r"_+", " ", re.sub(r"[^\w\s]", " ", value))
    return re.sub(r"\s+", " ", value).strip() or None


def apply(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


VECTORS = {
    "​R. and L. Acres Ltd.": "R AND L ACRES LTD",
    "CONSEIL COMMUNAUTAIRE DU GRAND-HAVRE": "CONSEIL COMMUNAUTAIRE DU GRAND HAVRE",
    "RÉSEAU ONTARIO DES ARTS DE LA SCÈNE INC.": "RESEAU ONTARIO DES ARTS DE LA SCENE INC",
    "ASSEMBLÉE DE LA FRANCOPHONIE DE L'ONTARIO": "ASSEMBLEE DE LA FRANCOPHONIE DE L ONTARIO",
    "...": None,
    "  ": None,
    "___": None,
    "\xa0Łódź\t½ ﬁn ß": "ŁODZ 1 2 FIN SS",
}


def test_vectors(spark):
    assert apply(spark, VECTORS, text.normalize) == list(VECTORS.values())
    assert apply(spark, [None], text.normalize) == [None]


# Letters whose case mappings have not changed between Unicode versions.
LATIN = st.characters(max_codepoint=0x17F)


@settings(max_examples=4, deadline=None, phases=[Phase.generate])
@given(st.lists(st.text(alphabet=LATIN, max_size=30), min_size=200, max_size=200))
def test_latin_matches_python_and_is_idempotent(spark, values):
    once = apply(spark, values, text.normalize)
    assert once == [python_normalize(v) for v in values]
    kept = [v for v in once if v]
    assert apply(spark, kept, text.normalize) == kept


def test_accents_match_python_for_every_assigned_character(spark):
    points = [
        cp
        for cp in range(1, 0x20000)
        if not 0xD800 <= cp <= 0xDFFF and unicodedata.category(chr(cp)) not in ("Cn", "Co")
    ]
    values = [f"a{chr(cp)}b" for cp in points]
    got = apply(spark, values, text.strip_accents)
    want = ["".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values]
    assert [(hex(cp), g, w) for cp, g, w in zip(points, got, want) if g != w] == []


@pytest.mark.parametrize(
    "options,expected",
    [
        ({"uppercase": False}, "Elan d o x"),
        ({"remove_accents": False}, "ÉLAN D O X"),
        ({"remove_punctuation": False}, "ELAN. D_O X"),
        ({"collapse_whitespace": False}, "ELAN  D O  X"),
    ],
)
def test_flags(spark, options, expected):
    assert apply(spark, [" Élan. d_o  x "], lambda c: text.normalize(c, **options)) == [expected]


def test_serialize_matches_python(spark):
    floats = [0.1, 100.0, 1234567.25, 12345678.9, 1e7, 1e15, 1e16, 1.5e-5, 0.00012, -2.5, 3e22, float("inf"), 0.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(floats)], "i int, v double")
    got = [r.k for r in rows.orderBy("i").select(text.serialize(F.col("v"), T.DoubleType()).alias("k")).collect()]
    assert got == [str(v) for v in floats]

    schema = "i int, d double, t timestamp_ntz, b boolean, s string"
    stamp = datetime(2020, 1, 2, 3, 4, 5)
    data = [(1, math.nan, stamp, True, "  x\t"), (2, None, stamp.replace(microsecond=120), None, ""), (3, 1.0, None, False, None)]
    table = spark.createDataFrame(data, schema)
    keys = table.orderBy("i").select(*[text.serialize(F.col(f.name), f.dataType).alias(f.name) for f in table.schema]).collect()
    assert [tuple(r) for r in keys] == [
        ("1", "<MISSING>", "2020-01-02T03:04:05", "True", "x"),
        ("2", "<MISSING>", "2020-01-02T03:04:05.000120", "<MISSING>", ""),
        ("3", "1.0", "<MISSING>", "False", "<MISSING>"),
    ]


def test_companion_columns(spark):
    assert text.companion_name("a", " two words ") == "a_two_words"
    table = spark.createDataFrame([("é",)], ["a"])
    assert text.with_normalized(table, "a").columns == ["a", "a_normalized_codex"]
    with pytest.raises(KeyError):
        text.with_normalized(table, "b")


def test_dates_print_alike_in_all_years(spark):
    stamps = ["0000-02-29 01:02:03", "0001-01-01 00:00:00", "-0044-03-15 12:00:00", "1998-02-06 00:00:00", "2020-01-31 23:59:59.5", "9999-12-31 23:59:59", "+12000-01-01 00:00:00", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(stamps)], "i int, v string").withColumn("t", F.col("v").cast("timestamp_ntz"))
    for mark in (" ", "T"):
        whole, fraction = F.date_format("t", f"yyyy-MM-dd'{mark}'HH:mm:ss"), F.date_format("t", "SSSSSS")
        want = F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))
        found = rows.select("v", text.display(F.col("t"), T.TimestampNTZType(), date_separator=mark).alias("got"), want.alias("want")).collect()
        assert [r.got for r in found] == [r.want for r in found] and found[3].got == f"1998-02-06{mark}00:00:00"
