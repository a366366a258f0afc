"""Removal of long repeated byte strings, found with a logarithmic family of sparse indexes of suffixes.

Every window of ``length`` bytes belongs to the first smallest fingerprint among its substrings of
``length // 3`` bytes, its *key*. The key depends on the window alone, so equal windows have equal
keys wherever they stand, and runs of neighbouring windows share one. A suffix array over the
starts of these runs is therefore enough to find every repeated window: it has about one entry per
140 bytes. Its entries are ordered by the fingerprint of the key string instead of the string, which brings
equal strings together just as the order of the strings would, and each also holds the fingerprint
of all bytes of its run. Strings count as equal if 128 bits of fingerprints agree.

Texts arrive in batches. A batch's array is merge-scanned against each level of the family; the
keys found on both sides are the long matches. It then becomes level 0, and two levels of equal
size merge into the next, as the digits of a binary counter carry. A string is thus rewritten
log2(batches) times, whatever the number of batches.

A run whose bytes all occur again needs nothing more. Where only the key is shared, a passage
begins or ends inside the run, and its windows are compared one by one, each under 128 bits of
fingerprint: in one task for keys with few runs, as counted rows for keys with many. The tables of
the family are written to the shared folder, which cuts the lineage.

Results for odd input: a null text is empty; a text shorter than ``length`` keeps all its bytes; a
null ``doc_id`` is an id like any other; rows with the same id and text each count as a copy of the
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import BLOCK_BYTES, Rolling, blocks, documents, small_batches, text_bytes

LENGTH = 400
BATCHES = 4
# Of two least fingerprints that agree in all bits but these, a place in a block, the leftmost counts.
PLACE_BITS = 20
# Runs with one key that a task compares at once; keys with more are compared window by window.
TOGETHER = 4_096

_RUNS = "key long, fp long, doc_id long, h binary, start int, n int"
_UNSURE = "key long, fp long, copies int, kinds long, doc_id long, h binary, start int, bytes binary"
_WINDOWS = "key long, window long, copies int, doc_id long, h binary, start int"
_SPANS = "doc_id long, h binary, start int, stop int"
_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, start and number of windows of every run with one key, its key and the print of its bytes."""
    part = length // 3
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    rolling = Rolling(data)
    parts = rolling.windows(part)
    # Of equal parts the leftmost counts, so a run never holds a window twice.
    places = np.arange(len(parts), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    chosen = _least((parts & ~low) | places, length - part + 1) & low
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    whole = np.arange(len(chosen)) + length <= offsets[1:][row_of]
    new = np.empty(len(chosen), bool)
    new[0], new[1:] = True, (chosen[1:] != chosen[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    last = np.flatnonzero(np.concatenate((new[1:] | ~whole[1:], [True])) & whole)
    prints = rolling.spans(first, last + length)
    return row_of[first], first - offsets[row_of[first]], last - first + 1, parts[chosen[first].astype(np.int64)], prints


def suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Entries of the sparse suffix array of each row: key, print of the run, place, windows.

    Rows of ``docs`` are ``doc_id, h, text``. A text longer than a block is read in pieces that
    overlap by ``length - 1`` bytes; the runs cut there are compared window by window later.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc_id, h = batch.column("doc_id"), batch.column("h")
            for a, b in blocks(offsets):
                low, high = offsets[a], offsets[b]
                step = high - low if b - a > 1 else BLOCK_BYTES
                for at in range(int(low), int(high), max(1, int(step))):
                    end = min(int(high), at + int(step) + length - 1) if b - a == 1 else int(high)
                    own = offsets[a : b + 1] - low if b - a > 1 else np.array([0, end - at])
                    row, start, n, key, prints = _runs(data[at:end], own, length)
                    if not len(row):
                        continue
                    shift = at - int(low) if b - a == 1 else 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            _signed(key),
                            _signed(prints),
                            doc_id.take(pa.array(row + a)),
                            h.take(pa.array(row + a)),
                            pa.array((start + shift).astype(np.int32)),
                            pa.array(n.astype(np.int32)),
                        ],
                        names=["key", "fp", "doc_id", "h", "start", "n"],
                    )

    return docs.mapInArrow(read, _RUNS)


class SuffixIndexFamily:
    """Suffix arrays in levels of doubling size, kept in a shared folder.

    An array is stored in sorted buckets of ``key, fp``, so two levels merge without an exchange.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.levels: dict[int, tuple[str, DataFrame]] = {}
        self._written = 0

    def _store(self, table: DataFrame) -> tuple[str, DataFrame]:
        path, name = f"{self.folder}/array-{self._written}", f"suffix_array_{uuid4().hex}"
        self._written += 1
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table.write.bucketBy(buckets, "key", "fp").sortBy("key", "fp").option("path", path).saveAsTable(name)
        array = self.spark.table(name)
        array.schema  # resolved now: the files stay when the catalog entry goes
        self.spark.sql(f"DROP TABLE {name}")
        return path, array

    def _drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add(self, entries: DataFrame) -> DataFrame:
        """Take in a batch; returns the keys of its long matches, inside it or with a level."""
        path, array = self._store(
            entries.withColumn("pick", F.xxhash64("doc_id", "h", "start"))
            .groupBy("key", "fp")
            .agg(F.count(F.lit(1)).cast("int").alias("copies"), F.min("pick").alias("pick"))
        )
        keys = array.groupBy("key").agg(F.sum("copies").alias("copies"))
        matches = keys.filter("copies > 1").select("key")
        for _, level in self.levels.values():
            matches = matches.union(level.select("key").join(keys, "key", "left_semi"))
        scanned = f"{self.folder}/matches-{self._written}"
        matches.distinct().write.parquet(scanned)
        size = 0
        while size in self.levels:
            old, level = self.levels.pop(size)
            more = array.withColumnsRenamed({"copies": "copies_2", "pick": "pick_2"})
            merged = level.join(more, ["key", "fp"], "full").select(
                "key",
                "fp",
                (F.coalesce("copies", F.lit(0)) + F.coalesce("copies_2", F.lit(0))).alias("copies"),
                F.least("pick", "pick_2").alias("pick"),
            )
            both, (path, array) = (path, old), self._store(merged)
            for gone in both:
                self._drop(gone)
            size += 1
        self.levels[size] = path, array
        return self.spark.read.parquet(scanned)

    def entries(self) -> DataFrame:
        """All entries of the family."""
        arrays = [array for _, array in self.levels.values()]
        if len(arrays) == 1:
            return arrays[0]
        every = arrays[0]
        for array in arrays[1:]:
            every = every.union(array)
        return every.groupBy("key", "fp").agg(F.sum("copies").cast("int").alias("copies"), F.min("pick").alias("pick"))


def _run_bytes(docs: DataFrame, length: int) -> DataFrame:
    """One row per run listed in ``runs`` (key, fp, copies, kinds, start, n) of each row, with its bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("row").field("text"))
            runs = batch.column("runs")
            flat = runs.flatten()
            sizes = np.diff(runs.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            begin = offsets[row] + flat.field("start").to_numpy(zero_copy_only=False)
            end = begin + flat.field("n").to_numpy(zero_copy_only=False) + length - 1
            own = pa.array([data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field(c) for c in ("key", "fp", "copies", "kinds")]
                + [batch.column("doc_id").take(rows), batch.column("h").take(rows), flat.field("start"), own],
                names=["key", "fp", "copies", "kinds", "doc_id", "h", "start", "bytes"],
            )

    return docs.mapInArrow(read, _UNSURE)


def _repeats_together(unsure: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that two runs of one key share, for keys with few runs."""

    def compare(table: pa.Table) -> pa.Table:
        fp, copies, start = (table.column(c).to_numpy() for c in ("fp", "copies", "start"))
        prints = [Rolling(np.frombuffer(b, np.uint8)).windows(length) for b in table.column("bytes").to_pylist()]
        _, once = np.unique(fp, return_index=True)
        values, counts = np.unique(np.concatenate([prints[k] for k in once]), return_counts=True)
        twice = values[counts > 1]
        rows, starts, stops = [], [], []
        for k in np.flatnonzero(copies == 1) if len(twice) else ():
            at = np.flatnonzero(np.isin(prints[k], twice))
            if len(at):
                new = np.concatenate(([True], np.diff(at) > 1))
                starts.append(at[new] + start[k])
                stops.append(at[np.concatenate((new[1:], [True]))] + start[k] + length)
                rows += [k] * int(new.sum())
        rows = pa.array(rows, pa.int64())
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(rows),
                "h": table.column("h").take(rows),
                "start": pa.array(np.concatenate(starts or [[]]).astype(np.int32)),
                "stop": pa.array(np.concatenate(stops or [[]]).astype(np.int32)),
            }
        )

    return unsure.groupBy("key").applyInArrow(compare, _SPANS)


def _repeats_apart(unsure: DataFrame, length: int) -> DataFrame:
    """The same for keys with any number of runs: windows are counted and joined back, however many."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                start = part.column("start").to_numpy()
                prints = [Rolling(np.frombuffer(b, np.uint8)).windows(length) for b in part.column("bytes").to_pylist()]
                sizes = [len(p) for p in prints]
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                places = np.concatenate([np.arange(n) + a for n, a in zip(sizes, start, strict=True)] or [start])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(rows), pa.array(np.concatenate(prints or [start]).view(np.int64))]
                    + [part.column(c).take(rows) for c in ("copies", "doc_id", "h")]
                    + [pa.array(places.astype(np.int32))],
                    names=["key", "window", "copies", "doc_id", "h", "start"],
                )

    windows = unsure.mapInArrow(read, _WINDOWS)
    twice = windows.groupBy("key", "window").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1").select("key", "window")
    return (
        windows.filter("copies = 1")
        .join(twice, ["key", "window"])
        .select("doc_id", "h", "start", (F.col("start") + length).alias("stop"))
    )


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by overlapping or touching intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((new[1:], [True]))
    return starts[new], ends[last]


def _cut(docs: DataFrame, carry: tuple[str, ...], keep_text: bool) -> DataFrame:
    """Texts of ``row`` without the bytes of their ``spans`` (start, stop); carried columns come from ``row`` too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_ = batch.column("row")
            data, offsets = text_bytes(row_.field("text"))
            spans = batch.column("spans")
            bounds, flat = spans.offsets.to_numpy(), spans.flatten()
            start, stop = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            base = bounds[0]
            removed, runs, prints, kept = [], [], [], []
            for row in range(len(offsets) - 1):
                own = data[offsets[row] : offsets[row + 1]]
                a, b = bounds[row] - base, bounds[row + 1] - base
                if b > a:
                    starts, ends = _merged(start[a:b], stop[a:b])
                    edges = np.concatenate(([0], np.column_stack((starts, ends)).ravel(), [len(own)]))
                    rest = b"".join(own[i:j].tobytes() for i, j in edges.reshape(-1, 2).tolist())
                    runs.append(len(starts))
                else:
                    rest = own.tobytes()
                    runs.append(0)
                removed.append(len(own) - len(rest))
                prints.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(prints, pa.string()),
                    pa.array(kept, pa.string()),
                ]
                + [row_.field(c) for c in carry],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *carry],
            )

    types = {f.name: f.dataType.simpleString() for f in docs.schema["row"].dataType}
    return docs.mapInArrow(read, _KEPT + "".join(f", `{c}` {types[c]}" for c in carry))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, *, batches: int = BATCHES, carry: tuple[str, ...] = (), keep_text: bool = False
) -> DataFrame:
    """Each row without the bytes covered by any string of ``length`` bytes that starts twice.

    Takes ``doc_id`` and ``text``, passes the columns named in ``carry`` on, and returns ``doc_id,
    n_bytes, n_removed, n_spans, kept_sha256`` and ``text``: null or, with ``keep_text``, what is left, but
    for bytes that a cut has left of a character.
    Rows are told apart by id and 128 bits of the text. ``batches`` is the number of additions to the
    index; the result does not depend on it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "suffixes")
    text = F.coalesce("text", F.lit("")).alias("text")
    # With its id, 128 bits of a text tell a row from every other: ids can be null or repeat.
    # Never null, or the joins below would filter nulls and no longer share an exchange.
    identity = F.coalesce(F.unhex(F.md5(F.coalesce("text", F.lit("")))), F.lit(b"")).alias("h")
    plain = docs.select("doc_id", identity, text)
    # Both joins below take whole rows, so that they share one exchange of the texts.
    docs = docs.select("doc_id", identity, F.struct(text, *carry).alias("row"))
    batch = F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)).cast("int").alias("batch")
    suffixes(plain, length).select("*", batch).write.partitionBy("batch").parquet(f"{folder}/entries")
    occurrences = spark.read.schema(f"{_RUNS}, batch int").parquet(f"{folder}/entries")

    family, matches = SuffixIndexFamily(spark, folder), None
    for k in range(batches):
        found = family.add(occurrences.filter(F.col("batch") == k).drop("batch"))
        matches = found if matches is None else matches.union(found)
    entries = family.entries().join(matches.distinct(), "key", "left_semi")
    kinds = entries.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    entries = entries.join(kinds, "key").select("key", "fp", "copies", "pick", "kinds")
    occurrences.drop("batch").join(entries, ["key", "fp"]).write.parquet(f"{folder}/repeated")
    repeated = spark.read.parquet(f"{folder}/repeated")

    spans = repeated.filter("copies > 1").select(
        "doc_id", "h", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop")
    )
    # One run stands for its copies.
    stands = (F.col("copies") == 1) | (F.xxhash64("doc_id", "h", "start") == F.col("pick"))
    listed = repeated.filter((F.col("kinds") > 1) & stands)
    unsure = listed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "fp", "copies", "kinds", "start", "n")).alias("runs"))
    here = [docs.doc_id.eqNullSafe(unsure.doc_id), docs.h == unsure.h]
    unsure = _run_bytes(docs.join(unsure, here).select(docs.doc_id, docs.h, "row", "runs"), length)
    few = F.col("kinds") <= TOGETHER
    spans = spans.union(_repeats_together(unsure.filter(few), length))
    if not listed.filter(~few).isEmpty():
        many = unsure.filter(~few).dropDuplicates(["key", "fp"])
        spans = spans.union(_repeats_apart(many, length))
    all_spans = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = docs.join(all_spans, [docs.doc_id.eqNullSafe(all_spans.doc_id), docs.h == all_spans.h], "left").select(
        docs.doc_id, docs.h, "row", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans")
    )
    return _cut(joined, carry, keep_text)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text")).drop("text")


# Every window of 400 bytes, as hexadecimal digits, is counted; overlapping windows that occur again make a run, and what
# lies between the runs is kept.
OP1_SQL = """
WITH spelled AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), sized AS (SELECT doc_id, x, length(x) // 2 AS n FROM spelled
), starts AS (SELECT doc_id, unnest(range(0, n - 399)) AS pos FROM sized
), windows AS (SELECT s.doc_id, s.pos, md5(substr(x, 2 * s.pos + 1, 800)) AS h FROM starts s JOIN sized USING (doc_id)
), again AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1
), runs AS (
  SELECT doc_id, min(pos) AS first, max(pos) + 400 AS stop FROM (
    SELECT *, sum(CASE WHEN pos <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
      SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM again))
  GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, coalesce(lag(stop) OVER w, 0) AS a, first AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY first)
  UNION ALL SELECT doc_id, max(stop), max(n) FROM runs JOIN sized USING (doc_id) GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, n FROM sized WHERE doc_id NOT IN (SELECT doc_id FROM runs)
), kept AS (
  SELECT doc_id, sha256(unhex(string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256 FROM pieces JOIN sized USING (doc_id) GROUP BY doc_id
), gone AS (SELECT doc_id, sum(stop - first) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM sized JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
