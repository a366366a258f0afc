"""Reading text columns as bytes, and hashing words, shingles and windows of them with numpy.

Texts reach Python as Arrow batches; their UTF-8 buffers are used in place, so no string object is
made per row. Every helper takes a block of rows at a time, cut so that its arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text worked on at a time; arrays of eight bytes per byte of text are made of it.
BLOCK_BYTES = 1 << 19
# Rows that go to Python at once. Texts of some kilobytes make buffers of some megabytes; Spark's own
# default of 10,000 rows would make them ten times as large, in the JVM and in Python.
BATCH_ROWS = 1_000
# The bytes that separate words, and A-Z.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, if it is higher; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether the row is kept from learning; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each row in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows and ``limit`` bytes each, or of one row."""
    row, last = 0, len(offsets) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, row + rows, last)
        yield row, end
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; equal in, equal out."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def random_words(n: int, seed: int) -> np.ndarray:
    """The first n values of a fixed sequence of 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


BYTE_VALUES = random_words(256, 17)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SEPARATOR = np.isin(np.arange(256), SEPARATORS)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Rolling:
    """Fingerprints of any substrings of a block of bytes, from one running sum."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self._down = _powers(_INVERSE, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _powers(_BASE, len(data)), out=self._sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Fingerprint of the window of ``length`` bytes at every position."""
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.empty(0, np.uint64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + mix((ends - starts).astype(np.uint64)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a block of rows, and the first word of each row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = IS_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~gap[:-1]
    before = np.concatenate(([True], gap[:-2])) | edge[:-1]
    after = gap[1:] | edge[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of ``size`` lower-cased words of each row, as sorted 64-bit hashes.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    starts, ends, first = words(data, offsets)
    hashes = Rolling(data, LOWER_VALUES).spans(starts, ends) if len(starts) else np.empty(0, np.uint64)
    n = len(hashes)

    def joined(at: np.ndarray, length: int) -> np.ndarray:
        value = np.full(len(at), length, np.uint64)
        for k in range(length):
            value = mix(value * np.uint64(_BASE) + hashes[at + k])
        return value

    whole = joined(np.arange(max(0, n - size + 1)), size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(joined(np.array([a]), b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bounded_sample(docs: DataFrame, most: int, seed: str, among: DataFrame | None = None) -> DataFrame:
    """``most`` of the distinct rows of ``doc_id, text``, or all if there are fewer: those with the least hashes of both.

    With ``among``, a table of distinct ``doc_id``, only of rows with one of its ids, with its other columns.
    Ids can be null or repeat. Equal rows are one, so copies do not crowd others out. The bound holds
    exactly but for rows with one 64-bit hash. Only hashes are counted, joined and sorted to find which
    rows are chosen; texts are looked up when few are left.
    """
    # A hash of its own for each row, however many share the id.
    hashed = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("chance_"))
    narrow = hashed.select("doc_id", "chance_")
    narrow = narrow.join(among.select("doc_id"), "doc_id") if among is not None else narrow
    distinct = narrow.agg(F.approx_count_distinct("chance_", 0.02).alias("n")).first()["n"]
    # Well more than are wanted; the estimate is a few hundredths off at most.
    scale = 1 << 40
    likely = F.pmod("chance_", F.lit(scale)) < int(scale * min(1.0, 1.5 * (most + 100) / max(distinct, 1)))
    last = narrow.filter(likely).select("chance_").distinct().orderBy("chance_").limit(most).agg(F.max("chance_")).first()[0]
    chosen = hashed.filter(likely & (F.col("chance_") <= F.lit(last).cast("long"))).drop("chance_").dropDuplicates(["doc_id", "text"])
    return chosen.join(among, "doc_id") if among is not None else chosen
