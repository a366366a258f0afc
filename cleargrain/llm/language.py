"""Language identification: multinomial naive Bayes over hashed character n-grams.

Grams of one to three lower-cased code points are hashed into 65,536 buckets. Learning counts them
by language in a bounded number of documents per language and sums the counts as rows of
(language, bucket), combined before the exchange. The matrix of log probabilities is broadcast in
slices of SLICE languages, so its size is bounded however many there are; batches of texts are
scored as the product of their sparse rows of gram counts with a slice, and carry the best language
so far from slice to slice. All languages are equally likely beforehand.

Results for odd input: a null or empty text and one without any letter is ``und`` with score 0, as
is every text if nothing could be learned; rows without language teach nothing; null and repeated
ids are rows like others; rows equal in id and text are learned from all or not at all, and count as
often as they occur; a text of any length is read in one task, whole; of languages of equal score
the first by name wins; an empty table gives an empty result; of other columns ``lang_pred`` and
``score`` are replaced and the rest are carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import documents, held_out, mix, small_batches

BUCKETS = 1 << 16
GRAMS = 3
DOCS_PER_LANGUAGE = 3_000
# Languages in a slice of the matrix: 32 MB of log probabilities.
SLICE = 128
SMOOTHING = 0.5
UNKNOWN = "und"


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams of some texts, row by row, and the number of grams of each row."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in lowered], np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    columns = np.full((len(points), GRAMS), BUCKETS, np.int64)
    value = np.zeros(len(points), np.uint64)
    for n in range(GRAMS if len(points) else 0):
        own = len(points) - n
        value[:own] = (value[:own] + points[n:]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n + 1)
        columns[:own, n] = (mix(value[:own]) >> np.uint64(48)).astype(np.int64)
        columns[left <= n, n] = BUCKETS
    return columns.ravel(), sizes * GRAMS


def _batches(texts: list[str], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for k, text in enumerate(texts):
        if k > first and held + len(text) > limit:
            yield first, k
            first, held = k, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def learn(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE, slice_size: int = SLICE) -> Iterator[tuple[list[str], np.ndarray]]:
    """Slices of languages in order of their names, each with its log probabilities by bucket and language.

    Learns from rows with ``doc_id, text, lang``. About ``per_language`` documents of each language are
    counted, chosen by a hash of id and text. A slice is learned when it is asked for, and the names
    of the next begin where it ended, so the driver holds one slice at a time.
    """
    small_batches(labelled.sparkSession)
    labelled = labelled.filter("lang IS NOT NULL")
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    last = None
    while True:
        rest = counted if last is None else counted.filter(F.col("lang") > last)
        known = {r["lang"]: r["n"] for r in rest.orderBy("lang").limit(slice_size).collect()}
        if not known:
            return
        yield list(known), _log_probabilities(labelled, known, per_language)
        if len(known) < slice_size:
            return
        last = list(known)[-1]


def _log_probabilities(labelled: DataFrame, known: dict[str, int], per_language: int) -> np.ndarray:
    """Of the buckets, and one more for grams past the end of a row, in each of the known languages."""
    languages = list(known)
    places = {name: k for k, name in enumerate(languages)}
    scale = 1 << 40
    chance = F.element_at(F.create_map(*[F.lit(x) for n in languages for x in (n, int(scale * min(1, per_language / known[n])))]), F.col("lang"))
    chosen = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")), F.lit(scale)) < chance
    sample = labelled.filter(F.col("lang").between(languages[0], languages[-1]) & chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = [t or "" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
            for a, b in _batches(texts):
                buckets, sizes = _grams(texts[a:b])
                names = sorted(set(langs[a:b]))
                index = np.repeat([names.index(x) for x in langs[a:b]], sizes) * (BUCKETS + 1) + buckets
                counts = np.bincount(index, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                for name, row in zip(names, counts, strict=True):
                    total[name] = total.get(name, 0) + row[:BUCKETS]
        for name, row in total.items():
            at = np.flatnonzero(row)
            place = np.full(len(at), places[name], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["place", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "place int, bucket int, n long")
    summed = counted.groupBy("place", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS + 1, len(languages)))
    counts[summed["bucket"], summed["place"]] = summed["n"]
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
    logs[BUCKETS] = 0  # grams past the end of a row
    return logs.astype(np.float32)


def _compared(rows: DataFrame, languages: list[str], logs: np.ndarray, best: str) -> DataFrame:
    """Compare the languages of one slice with the best before them, held in the column ``best``.

    Its fields are the name, its log score and the sum of the odds of all languages so far against it.
    """
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    others = [c for c in rows.columns if c != best]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found: list[dict | None] = []
            before = batch.column(best).to_pylist()
            for a, b in _batches(texts):
                buckets, sizes = _grams(texts[a:b])
                ends = np.cumsum(sizes)
                totals = np.zeros((b - a, len(languages)))
                some = sizes > 0
                if some.any():
                    totals[some] = np.add.reduceat(shared.value[buckets], (ends - sizes)[some], axis=0, dtype=np.float64)
                for text, row, old in zip(texts[a:b], totals, before[a:b], strict=True):
                    if not letter.search(text):
                        found.append(None)
                        continue
                    first = int(row.argmax())
                    top, name = float(row[first]), languages[first]
                    if old and old["top"] >= top:
                        top, name = old["top"], old["name"]
                    odds = float(np.exp(row - top).sum()) + (old["odds"] * float(np.exp(old["top"] - top)) if old else 0.0)
                    found.append({"name": name, "top": top, "odds": odds})
            kind = pa.struct([("name", pa.string()), ("top", pa.float64()), ("odds", pa.float64())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, kind)], names=[*others, best])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != best)
    return rows.mapInArrow(read, f"{schema}`{best}` struct<name:string,top:double,odds:double>")


def predict(docs: DataFrame, slices: Iterable[tuple[list[str], np.ndarray]]) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, its probability, to rows with a ``text``, which is dropped.

    One pass per slice; between two of them the rows are written to the shared folder and reread.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    best = "best_"
    while best in docs.columns:
        best += "_"
    rows = docs.withColumn(best, F.lit(None).cast("struct<name:string,top:double,odds:double>"))
    for k, (languages, logs) in enumerate(slices):
        if k:
            path = f"{scratch_path(spark, 'language')}/{k}"
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
        rows = _compared(rows, languages, logs, best)
    named = F.coalesce(F.col(f"{best}.name"), F.lit(UNKNOWN)).alias("lang_pred")
    chance = F.coalesce(1 / F.col(f"{best}.odds"), F.lit(0.0)).alias("score")
    return rows.select(*[f"`{c}`" for c in docs.columns if c != "text"], named, chance)


def identify(docs: DataFrame, held: Column, slice_size: int = SLICE) -> DataFrame:
    """Learns from the rows that are not ``held`` and predicts all."""
    slices = learn(docs.filter(~held).select("doc_id", "text", "lang"), slice_size=slice_size)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), slices)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"), held_out("doc_id", 4, 2))
