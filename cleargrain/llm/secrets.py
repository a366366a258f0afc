"""Secret scans with multipart credential linking.

Parts of a text are identifiers (``access`` keys, ``account`` names), secrets (``assign``: a value
given to a telling name, ``hex`` runs, ``opaque`` strings of mixed characters) and ``endpoint``
addresses. The first three kinds, access, assign and hex, are reported wherever they are. An account,
an opaque string or an endpoint alone is weak, and is reported only where it completes a credential:

- the scope of an identifier is what lies within ``REACH`` code points of it in its paragraph
  (blank lines part paragraphs);
- a weak account needs a secret that begins in its scope;
- an opaque string needs an identifier in whose scope it begins;
- an endpoint needs an identifier in whose scope both it and a secret begin.

A pass over the texts finds the parts and writes them, without the texts. The scopes are an interval
join: each part has the bin of its start, each scope the few bins that it crosses, so rows meet by
text and bin, a very long text is many keys, and two parts meet once. Nothing lists all pairs: weak
parts are found by semi-joins, and an identifier is linked to the nearest secret and endpoint.

Results for odd input: a null text is empty, an empty text has no spans; rows are scanned one by one,
whatever their ids, so null, equal and repeated rows each give a row; texts may be of any length; of
equally near parts the first is linked; an empty table gives an empty result; other columns are ignored.
Positions are code points, ends exclusive. Letters of a pattern that matches either case are ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import documents, small_batches

# The kinds in the order in which spans of one start are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
ASSIGN, ACCESS, HEX, ACCOUNT, OPAQUE, ENDPOINT = range(6)
_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    ASSIGN: rf"(?ai)(?:password|passwd|secret|token|api_?key){_GIVEN}([A-Za-z0-9+/_.=-]+)",
    ACCESS: r"(AKIA[A-Z0-9]+)",
    HEX: r"([0-9a-f]+)",
    ACCOUNT: rf"(?ai)(?:user(?:name)?|login|account|client_?id){_GIVEN}([A-Za-z0-9@._+-]+)",
    OPAQUE: r"([A-Za-z0-9+/_=-]{20,})",
    ENDPOINT: r"([A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+)",
}
LEAST = {ASSIGN: 8, ACCESS: 16, HEX: 32, ACCOUNT: 3, OPAQUE: 20, ENDPOINT: 0}
# What a text must hold for a pattern to have a match that counts; looked for in whole batches.
NEEDS = {
    ASSIGN: r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    ACCESS: r"AKIA[A-Z0-9]{12}",
    HEX: r"[0-9a-f]{32}",
    ACCOUNT: r"(?i)(user(name)?|login|account|client_?id)[\"']?\x20*[:=]",
    OPAQUE: r"[A-Za-z0-9+/_=-]{20}",
    ENDPOINT: r"://",
}
BASE, IDENTIFIERS, SECRETS = (ASSIGN, ACCESS, HEX), (ACCESS, ACCOUNT), (ASSIGN, HEX, OPAQUE)
REACH = 400
BIN = 1024
# An opaque string has characters of each of these kinds.
_MIXED = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]
_FOUND = {k: re.compile(p) for k, p in PATTERNS.items()}
_BLANK_LINE = re.compile(r"\n[ \t\r]*(?=\n)")

SPAN = "struct<start:bigint,kind:int,end:bigint>"
PART = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def spans(text: str, kind: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of one kind, from left to right; short ones are dropped after they are found."""
    if kind == HEX:
        # The same runs, without a match for each short one.
        return [(m.start(), kind, m.end()) for m in re.finditer("[0-9a-f]{%d,}" % LEAST[HEX], text)]
    return [
        (m.start(), kind, m.end())
        for m in _FOUND[kind].finditer(text)
        if m.end(1) - m.start(1) >= LEAST[kind] and (kind != OPAQUE or all(p.search(m[1]) for p in _MIXED))
    ]


def _parts(text: str, base: list[tuple], kinds: list[int]) -> list[dict]:
    """Everything that can be part of a credential, with the scopes of identifiers; weak parts do not touch base ones."""
    weak = [s for k in kinds for s in spans(text, k)]
    covered, k = [], 0
    merged = sorted((s, e) for s, _, e in base)
    for start, kind, end in sorted(weak):
        while k < len(merged) and merged[k][1] <= start:
            k += 1
        if k == len(merged) or merged[k][0] >= end:
            covered.append((start, kind, end))
    found = sorted(base + covered)
    # Without an identifier and a secret nothing can be linked.
    if not any(k in IDENTIFIERS for _, k, _ in found) or not any(k in SECRETS for _, k, _ in found):
        return []
    breaks, at, out = [0, *(m.end() for m in _BLANK_LINE.finditer(text)), len(text)], 0, []
    for start, kind, end in found:
        while at + 2 < len(breaks) and breaks[at + 1] <= start:
            at += 1
        low, high = max(breaks[at], start - REACH), min(breaks[at + 1], end + REACH)
        scope = {"low": low, "high": high} if kind in IDENTIFIERS else {"low": None, "high": None}
        out.append({"start": start, "kind": kind, "end": end, **scope})
    return out


def find_parts(docs: DataFrame, path: str) -> DataFrame:
    """``row, doc_id``, the ``base`` spans of ``text`` and its ``parts``, written once so that rows keep their number."""
    spark = docs.sparkSession
    small_batches(spark)
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind_of}, base array<{SPAN}>, parts array<struct<start:bigint,kind:int,end:bigint,low:bigint,high:bigint>>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            may = {k: pc.fill_null(pc.match_substring_regex(column, p), False).to_pylist() for k, p in NEEDS.items()}
            base, parts = [[] for _ in range(len(column))], [[] for _ in range(len(column))]
            for i in range(len(column)):
                strong = [k for k in BASE if may[k][i]]
                weak = [k for k in (ACCOUNT, OPAQUE, ENDPOINT) if may[k][i]]
                if strong or (ACCOUNT in weak and OPAQUE in weak):
                    text = column[i].as_py()
                    base[i] = sorted(s for k in strong for s in spans(text, k))
                    parts[i] = _parts(text, base[i], weak)
            named = [[dict(zip(("start", "kind", "end"), s)) for s in found] for found in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(named, SPANS), pa.array(parts, pa.list_(PART))], names=["row", "doc_id", "base", "parts"]
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    numbered.mapInArrow(read, schema).write.parquet(path)
    return spark.read.parquet(path)


KEYS = ("row", "start", "kind", "end")
_WHO = tuple(f"who_{c}" for c in KEYS)


def _scoped(identifiers: DataFrame) -> DataFrame:
    """Each scope under every bin that it crosses."""
    bins = F.sequence(F.floor(F.col("low") / BIN), F.floor((F.col("high") - 1) / BIN))
    return identifiers.select(*_WHO, "low", "high", F.explode(bins).alias("who_bin"))


def _in_scope() -> Column:
    return (F.col("who_row") == F.col("row")) & (F.col("who_bin") == F.col("bin")) & (F.col("start") >= F.col("low")) & (F.col("start") < F.col("high"))


def _nearest(scopes: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Identifiers with the part of their scope that is nearest to them, if there is one."""
    apart = F.greatest(F.col("start") - F.col("who_end"), F.col("who_start") - F.col("end"))
    best = F.min(F.struct(apart.alias("apart"), "start", "kind", "end"))
    near = scopes.join(parts, _in_scope()).groupBy(*_WHO, "low", "high").agg(best.alias("best"))
    return near.select(*_WHO, "low", "high", F.struct("best.start", "best.kind", "best.end").alias(name))


def credentials(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linked identifiers and reported weak parts of the rows of :func:`find_parts`.

    The first has ``row, start, kind, end`` of every identifier with a secret in its scope, and the
    nearest ``secret`` and ``endpoint`` (or null) as spans; the second ``row, start, kind, end`` of the
    weak parts that some credential needs.
    """
    parts = found.filter(F.size("parts") > 0).select("row", F.inline("parts"))
    placed = parts.select(*KEYS, F.floor(F.col("start") / BIN).alias("bin"))
    secrets, endpoints = placed.filter(F.col("kind").isin(*SECRETS)), placed.filter(F.col("kind") == ENDPOINT)
    who = [F.col(c).alias(w) for c, w in zip(KEYS, _WHO, strict=True)]
    scopes = _scoped(parts.filter(F.col("kind").isin(*IDENTIFIERS)).select(*who, "low", "high"))
    linked = _nearest(scopes, secrets, "secret")
    wide = _scoped(linked)
    full = linked.join(_nearest(wide, endpoints, "endpoint").drop("low", "high"), list(_WHO), "left")
    named = [F.col(w).alias(c) for c, w in zip(KEYS, _WHO, strict=True)]
    weak = [
        linked.filter(F.col("who_kind") == ACCOUNT).select(*named),
        secrets.filter(F.col("kind") == OPAQUE).join(scopes, _in_scope(), "left_semi").select(*KEYS),
        endpoints.join(wide, _in_scope(), "left_semi").select(*KEYS),
    ]
    return full.select(*named, "secret", "endpoint"), weak[0].unionByName(weak[1]).unionByName(weak[2])


def listed(found: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` of each row with its ``base`` spans and ``spans``, which add the linked weak ones, as sorted arrays of structs."""
    found = find_parts(docs, f"{scratch_path(docs.sparkSession, 'secrets')}/parts")
    _, weak = credentials(found)
    span = F.struct("start", "kind", "end")
    # As long as the text's own list of spans.
    more = weak.groupBy("row").agg(F.collect_list(span).alias("more"))
    none = F.array().cast(f"array<{SPAN}>")
    linkable = F.size("parts") > 0
    joined = found.filter(linkable).join(more, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))
    return found.filter(~linkable).select("doc_id", "base", F.col("base").alias("spans")).unionByName(joined)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir, "doc_id", "text"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", number(ASSIGN), number(ACCESS), number(HEX), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
