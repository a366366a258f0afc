"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Six kinds of triplets, up to 16 bytes wide, are hashed into 512 buckets. A digest holds, in
hexadecimal, the length of the text on a logarithmic scale (4 digits), how the quartiles of the
bucket counts compare (2 digits), and for each bucket the quarter that its count falls in (256
digits). Two digests differ by the quarters apart, bucket by bucket, a whole range apart counting
double, and by length and quartiles; the likeness is 1 less this difference over its bound.

Bytes past the end count as zero, so the shortest texts differ too. An empty text has all-zero
digits; a null text counts as empty. Equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import blocks, documents, random_words, small_batches, text_bytes

BUCKETS = 512
# Fixed values of the digest: the places of each kind of triplet, and how far differences count.
TRIPLETS = ((0, 3, 7), (0, 2, 9), (0, 5, 11), (0, 4, 6), (0, 8, 13), (0, 7, 15))
WIDTH = 16
LENGTH_STEPS = 32
LENGTH_BOUND, RATIO_BOUND, BODY_BOUND = 0.2, 0.05, 1.5
_NO_ID = -(1 << 63)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Triplets of each row in each bucket."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(rows), sizes)
    place = np.arange(len(data)) + row * (WIDTH - 1)
    values = np.full(len(data) + rows * (WIDTH - 1), np.uint32(0x1B873593), np.uint32)
    values[place] = (random_words(256, 5) >> np.uint64(32)).astype(np.uint32)[data]
    base = np.full(len(values), rows * BUCKETS, np.int64)
    base[place] = row * BUCKETS
    n = len(values) - WIDTH + 1
    total = np.zeros(rows * BUCKETS, np.int64)
    factors = (random_words(3 * len(TRIPLETS), 6) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for k, (i, j, m) in enumerate(TRIPLETS if n > 0 else ()):
        hashed = values[i : i + n] * factors[3 * k] + values[j : j + n] * factors[3 * k + 1]
        hashed += values[m : m + n] * factors[3 * k + 2]
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        total += np.bincount(base[:n] + (hashed >> np.uint32(23)), minlength=(rows + 1) * BUCKETS)[: rows * BUCKETS]
    return total.reshape(rows, BUCKETS)


class Digests:
    """Digests of a block of texts, as arrays."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        counts = _counts(data, offsets)
        at = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
        quartiles = np.partition(counts, at, axis=1)[:, at]
        self.body = sum((counts > quartiles[:, k : k + 1]).astype(np.int8) for k in range(3))
        self.length = np.minimum(np.rint(LENGTH_STEPS * np.log2(np.diff(offsets) + 1.0)), 0xFFFF).astype(np.int64)
        top = np.maximum(quartiles[:, 2], 1)
        self.ratios = np.minimum(quartiles[:, :2] * 15 // top[:, None], 15)

    def texts(self) -> list[str]:
        packed = self.body.reshape(len(self.body), -1, 4).astype(np.uint8)
        packed = packed[:, :, 0] << 6 | packed[:, :, 1] << 4 | packed[:, :, 2] << 2 | packed[:, :, 3]
        head = zip(self.length.tolist(), self.ratios.tolist(), strict=True)
        return [f"{n:04x}{a:x}{b:x}{body.tobytes().hex()}" for (n, (a, b)), body in zip(head, packed, strict=True)]

    def likeness(self, mine: np.ndarray, other: Digests, theirs: np.ndarray) -> np.ndarray:
        apart = np.abs(self.body[mine] - other.body[theirs])
        body = (apart + 3 * (apart == 3)).mean(axis=1) / BODY_BOUND
        length = np.abs(self.length[mine] - other.length[theirs]) / (16 * LENGTH_STEPS) * LENGTH_BOUND
        ratios = np.abs(self.ratios[mine] - other.ratios[theirs]).mean(axis=1) / 15 * RATIO_BOUND
        return np.round(1 - np.minimum(1.0, body + np.minimum(length, LENGTH_BOUND) + ratios), 6)


def likeness(left: str, right: str) -> float:
    """Likeness of two digests from their text form, from 0 to 1."""

    def opened(text: str) -> Digests:
        it = object.__new__(Digests)
        packed = np.frombuffer(bytes.fromhex(text[6:]), np.uint8)
        it.length, it.ratios = np.array([int(text[:4], 16)]), np.array([[int(c, 16) for c in text[4:6]]])
        it.body = np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(1, -1).astype(np.int8)
        return it

    return float(opened(left).likeness(np.array([0]), opened(right), np.array([0]))[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds the digest of ``text`` as ``fingerprint``; the text is dropped, all else carried."""
    small_batches(docs.sparkSession)
    docs = docs.drop("fingerprint")
    carried = [c for c in docs.columns if c != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text") + "fingerprint string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out: list[str] = []
            for a, b in blocks(offsets, rows=512):
                out += Digests(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).texts()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(out, pa.string())], names=[*carried, "fingerprint"])

    return docs.mapInArrow(read, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in runs of descending id, each run ended by a copy of the row that follows it.

    The last run is followed by the first row. Ids are cut into ranges at quantiles; the driver
    holds two numbers per range. Rows equal in id are ordered by the hash of their text; null ids
    come last. Each row is exchanged once, and once more if it begins a range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("long")
    def range_of(i: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, i.to_numpy(), "left"))

    firsts = {r["range"]: r["top"] for r in ids.groupBy(range_of("id").alias("range")).agg(F.max("id").alias("top")).collect()}
    order = sorted(firsts)
    before = {firsts[order[k]]: order[k - 1] for k in range(len(order))}

    @F.pandas_udf("long")
    def ends(i: pd.Series) -> pd.Series:
        return pd.Series([before.get(x, -1) for x in i.tolist()], dtype="int64")

    rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).withColumns(
        {"range_": range_of("id"), "ends_": ends("id"), "hash_": F.xxhash64("text")}
    )
    places = F.array(F.struct(F.col("range_").alias("range"), F.lit(0).alias("extra")), F.struct(F.col("ends_").alias("range"), F.lit(1).alias("extra")))
    dealt = rows.withColumn("at_", F.explode(places)).select("*", "at_.range", "at_.extra").filter("range >= 0").drop("at_", "range_", "ends_")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("range").cast("int"))
    return dealt.sortWithinPartitions("range", "extra", F.desc("id"), "hash_").drop("hash_", "id")


_EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each text's digest beside that of its edited form and of the next text, by descending id.

    The edited form replaces the last third of the code points by as many of the next text's first.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(own: list[tuple]) -> Iterator[pa.RecordBatch]:
            texts = [r[1] for r in own]
            mine = [k for k in range(len(own) - 1) if not own[k][3] and own[k + 1][2] == own[k][2]]
            if not mine:
                return
            edited = []
            for k in mine:
                cut = len(texts[k]) // 3
                edited.append(texts[k][: len(texts[k]) - cut] + texts[k + 1][:cut])
            base, changed = Digests(*text_bytes(pa.array(texts, pa.large_string()))), Digests(*text_bytes(pa.array(edited, pa.large_string())))
            at = np.array(mine)
            shown = base.texts()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([own[k][0] for k in mine], pa.int64()),
                    pa.array([len(texts[k]) for k in mine], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([shown[k] for k in mine], pa.string()),
                    pa.array(changed.texts(), pa.string()),
                    pa.array(base.likeness(at, changed, np.arange(len(at)))),
                    pa.array(base.likeness(at, base, at + 1)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "range", "extra")), strict=True):
                    held.append(row)
                    size += len(row[1])
                    if size > 1 << 20 or len(held) > 512:
                        yield from flush(held)
                        held, size = held[-1:], 0
        yield from flush(held)

    return rows.mapInArrow(read, _EDITED)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(documents(spark, sf_dir, "doc_id", "text"))
