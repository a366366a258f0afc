"""Near duplicates by word shingles: banded MinHash, sequential Bayesian pruning, exact verification.

1. Documents with equal shingle sets are one node, so copies never form pairs.
2. Bands of signature values put nodes into buckets. The number of bands follows from the
   similarity and the chosen miss probability.
3. In each bucket the nodes are compared with one leader, the node that meets most others; what
   links to the leader needs no pairs among itself. Buckets whose nodes are then still in several
   components are compared in full, across components, tile by tile in tasks of their own.
4. A candidate pair is compared signature batch by signature batch. With m of n values equal the
   similarity is distributed as Beta(m + 1, n - m + 1); the pair is dropped as soon as it reaches
   the threshold with less than the miss probability.
5. Survivors are linked if their full shingle sets say so. Sets are recomputed from the texts of
   nodes that share a bucket, each text once.

Links form components by distributed star contraction; nothing about documents reaches the driver.

Results for odd input: a null or empty text, or one of white space only, has no shingles and links
with nothing; fewer words than a shingle count as one shingle; rows with one id are each judged by
their own text and share the id; a null id sorts before all others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .components import connected_components
from .texts import blocks, documents, mix, random_words, shingles, small_batches, text_bytes

ROWS = 5
MISS = 1e-6
BATCH = 20
# Nodes, and hashes of their sets, that a task compares against as many.
TILE = 512
TILE_HASHES = 1 << 20
_NO_ID = -(1 << 63)


def bands_needed(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a pair at the threshold unfound with at most the miss probability."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def least_matches(similarity: float, n: int, miss: float = MISS) -> int:
    """Fewest of n equal values at which the similarity is reached with more than the miss probability."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total > miss:
            return m
    return n


def signature(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Least value of the set under each seed's permutation of 32-bit values."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 2048):
        grid = folded[at : at + 2048][None, :] * seeds[:, None]
        grid ^= grid >> np.uint32(15)
        grid *= np.uint32(0x2C1B3C6D)
        grid ^= grid >> np.uint32(13)
        np.minimum(best, grid.min(axis=1), out=best)
    return best


def _signatures(docs: DataFrame, size: int, values: int) -> DataFrame:
    """Set size, 128-bit print of the set and signature of each row's ``text``."""
    seeds = (random_words(values, 91) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts, a, b, out = [], [], [], []
            for low, high in blocks(offsets):
                own = offsets[low : high + 1]
                for hashes in shingles(data[own[0] : own[-1]], own - own[0], size):
                    counts.append(len(hashes))
                    a.append(int(mix(hashes).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(mix(hashes ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64).view(np.int64)))
                    out.append(signature(hashes, seeds).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "a", "b", "sig"],
            )

    return docs.mapInArrow(read, "doc_id long, text_hash long, n_shingles long, a long, b long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), -1)


def _buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("sig")).astype(np.uint64)
            node = batch.column("node").to_numpy()
            for band in range(bands):
                value = np.full(len(node), band + 1, np.uint64)
                for k in range(band * rows, band * rows + rows):
                    value = mix(value * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                bands_ = pa.array(np.full(len(node), band, np.int32))
                yield pa.RecordBatch.from_arrays([bands_, pa.array(value.view(np.int64)), pa.array(node)], names=["band", "bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(read, "band int, bucket long, node long")


def likely(left: np.ndarray, right: np.ndarray, floors: list[tuple[int, int]]) -> np.ndarray:
    """Pairs of signature rows that survive every batch."""
    kept, matches, at = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in floors:
        matches = matches + (left[kept, at:n] == right[kept, at:n]).sum(axis=1)
        good = matches >= least
        kept, matches, at = kept[good], matches[good], n
    return kept


def _prune(pairs: DataFrame, floors: list[tuple[int, int]]) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = pa.array(likely(_matrix(batch.column("sig_u")), _matrix(batch.column("sig_v")), floors))
                yield batch.select(["u", "v"]).take(kept)

    return pairs.mapInArrow(read, "u long, v long")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node, hashes`` of rows whose text has the set that the node stands for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            a, node, keep, out = batch.column("a").to_numpy(), batch.column("node"), [], []
            row = 0
            for low, high in blocks(offsets):
                own = offsets[low : high + 1]
                for hashes in shingles(data[own[0] : own[-1]], own - own[0], size):
                    if mix(hashes).sum(dtype=np.uint64).view(np.int64) == a[row]:
                        keep.append(row)
                        out.append(hashes.tobytes())
                    row += 1
            yield pa.RecordBatch.from_arrays([node.take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["node", "hashes"])

    return docs.mapInArrow(read, "node long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity, in whole hundredths."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(row)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(read, "u long, v long")


def _across(members: DataFrame, floors: list[tuple[int, int]], rows: int, percent: int) -> DataFrame:
    """Links of one bucket between different components, found and verified tile by tile.

    Nodes are dealt into ``tiles`` parts by hash; a part meets itself and every later part in a task
    of its own, which holds two parts of bounded size. A pair is judged only in the first band it
    shares, and of the links in a tile only those that connect something new are returned.
    """
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    dealt = members.withColumn("tile", own)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    parts = dealt.select("*", every.alias("other")).select(
        "band", "bucket", "node", "component", "sig", "hashes", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        sig = _matrix(table.column("sig").combine_chunks())
        by_band = sig.reshape(len(sig), -1, rows)
        node, component, tile = (table.column(c).to_numpy().copy() for c in ("node", "component", "tile"))
        band = table.column("band")[0].as_py()
        sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        marked = np.zeros(len(names), np.int64)
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        us, vs = [], []
        for x in left.tolist():
            ys = right[component[right] != component[x]]
            if i == j:
                ys = ys[node[ys] > node[x]]
            if not len(ys):
                continue
            ys = ys[(by_band[ys] == by_band[x]).all(axis=2).argmax(axis=1) == band]
            ys = ys[likely(np.broadcast_to(sig[x], (len(ys), sig.shape[1])), sig[ys], floors)]
            if not len(ys):
                continue
            mine = flat[starts[x] : starts[x] + sizes[x]]
            marked[mine] = 1
            ends = np.cumsum(sizes[ys])
            at = np.repeat(starts[ys] - (ends - sizes[ys]), sizes[ys]) + np.arange(ends[-1])
            both = np.add.reduceat(marked[flat[at]], ends - sizes[ys])
            marked[mine] = 0
            for y in ys[100 * both >= percent * (sizes[x] + sizes[ys] - both)].tolist():
                if component[x] != component[y]:
                    # From here on the two are one, and their members need no comparison.
                    component[component == component[y]] = component[x]
                    us.append(min(node[x], node[y]))
                    vs.append(max(node[x], node[y]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return parts.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS, groups: bool = False
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` per row; the smallest id of a component names it.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of ``shingle`` words.
    ``groups`` adds ``group``, which tells components apart where ids are null or repeat; it is null
    for a row without shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "minhash")
    similarity = percent / 100
    bands = bands_needed(similarity, rows, miss)
    floors = [(n, least_matches(similarity, n, miss)) for n in range(BATCH, bands * rows + 1, BATCH)]

    def stored(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    plain = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(_signatures(plain.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), shingle, bands * rows), "sets")
    nodes = sets.filter("n_shingles > 0").groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")
    )
    nodes = nodes.select("a", "b", F.col("least.doc_id").alias("first"), F.col("least.text_hash").alias("first_hash"), "sig", "n_shingles")
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = _buckets(nodes, bands, rows)
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stored(buckets.join(sizes, "bucket"), "shared")

    meets = shared.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = shared.join(meets, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("top"))
    led = ranked.join(leaders, "bucket").select("node", F.col("top.node").alias("leader")).filter("node <> leader")
    pairs = led.select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct()
    sigs = nodes.select("node", "sig")
    signed = pairs.join(sigs.withColumnsRenamed({"node": "u", "sig": "sig_u"}), "u").join(
        sigs.withColumnsRenamed({"node": "v", "sig": "sig_v"}), "v"
    )
    likely_pairs = _prune(signed, floors)

    # By id and text: one id can stand for many nodes.
    first = nodes.select("node", "a", F.col("first").alias("doc_id"), F.col("first_hash").alias("text_hash"))
    wanted = shared.select("node").distinct().join(first, "node")
    hashed = plain.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    full = stored(_full_sets(hashed.join(wanted, ["doc_id", "text_hash"]), shingle).dropDuplicates(["node"]), "full")
    links = stored(_verified(likely_pairs, full, percent), "links")
    found = connected_components(links)

    labelled = shared.join(nodes.select("node", "n_shingles"), "node").join(found, "node", "left")
    labelled = labelled.select("band", "bucket", "node", "size", "n_shingles", F.coalesce("component", "node").alias("component"))
    open_buckets = (
        labelled.groupBy("bucket")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.max("size").alias("size"),
            F.sum("n_shingles").alias("hashes"),
        )
        .filter("size > 2 AND low <> high")
        .select("bucket", F.ceil(F.greatest(F.col("size") / TILE, F.col("hashes") / TILE_HASHES)).alias("tiles"))
    )
    rest = labelled.drop("size", "n_shingles").join(open_buckets, "bucket").join(nodes.select("node", "sig"), "node").join(full, "node")
    more = stored(_across(rest, floors, rows, percent), "more")
    links = spark.read.schema("u long, v long").parquet(f"{folder}/links", f"{folder}/more")
    found = connected_components(links) if not more.isEmpty() else found

    of_node = nodes.select("a", "b", "node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = of_node.select("a", "b", "component", "first")
    names = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of_node.join(names, "component").select("a", "b", "component_id", F.col("component").alias("group"))
    ids = sets.select("doc_id", "text_hash", "n_shingles", "a", "b").join(named, ["a", "b"], "left").select(
        "doc_id", "text_hash", "n_shingles", "group", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    out = ids.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.select(
        *(F.nullif(F.col(c), F.lit(_NO_ID)).alias(c) if c != "n_shingles" else F.col(c) for c in ("doc_id", "n_shingles", "component_id")), "kept", "text_hash", *(["group"] if groups else [])
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3, percent=85).drop("text_hash")


# All pairs that share a shingle, counted, and what can be reached from each document along the links.
OP7_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
  FROM worded
), items AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""
