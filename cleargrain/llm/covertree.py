"""Exact top-k by inner product: dual-tree search over cover trees of the queries and of the data.

Vectors are dealt into blocks of bounded size; every block of queries meets every block of data in a
task of its own. There both become cover trees: a node has one of its own points as center and a
covering radius, and its children are picked so that each point lies within half the radius of a
child's center while the centers keep that far apart. Pairs of nodes are visited best first. For
points q and d under centers a and b with radii r and s,

    q.d <= a.b + r |b| + s |a| + r s

and a pair is dropped if this is below the worst kth score of its query group. Scores are whole
numbers and computed exactly. The best k of each block pair are merged per query.

Results for odd input: a vector that is null or holds a null or non-finite component, or has no id,
takes no part; vectors of different lengths are never compared; rows equal in id and vector count
once; other rows of one id are candidates, and as queries are ranked together; all rows with the
query's id count as its own; a query without candidates has no rows;
an empty table gives an empty result; a score beyond a long is cut to the largest or smallest long;
other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
DATA_BLOCK = 8_192
QUERY_BLOCK = 2_048
LEAF = 64
_LEAST = -(1 << 63)


class Node:
    """Rows under one center, with the radius that covers them; ``children`` is empty for a leaf."""

    __slots__ = ("center", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray, center: int):
        self.rows, self.center, self.children = rows, center, []
        away = np.sqrt(((points[rows] - points[center]) ** 2).sum(axis=1))
        self.radius = float(away.max()) * (1 + 1e-12)
        self.norm = float(np.sqrt((points[center] ** 2).sum()))
        if len(rows) > LEAF and self.radius > 0:
            self._split(points, away)

    def _split(self, points: np.ndarray, away: np.ndarray) -> None:
        """Centers are taken farthest first; where they would outnumber a quarter of the rows, halving
        the radius does not group the points, and the rows stay one leaf."""
        centers, nearest, owner = [self.center], away.copy(), np.zeros(len(self.rows), np.int64)
        while nearest.max() > self.radius / 2:
            if len(centers) > len(self.rows) // 4:
                return
            at = int(nearest.argmax())
            distance = np.sqrt(((points[self.rows] - points[self.rows[at]]) ** 2).sum(axis=1))
            closer = distance < nearest
            owner[closer], nearest[closer] = len(centers), distance[closer]
            centers.append(int(self.rows[at]))
        self.children = [Node(points, self.rows[owner == k], c) for k, c in enumerate(centers)]


def cover_tree(points: np.ndarray) -> Node:
    return Node(points, np.arange(len(points)), 0)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the k best (score, id), ties to the smaller id, its own id left out."""
    most = [max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) for x in (queries, data)]
    exact = most[0] * most[1] * max(1, data.shape[1]) < 2.0**52
    # The trees use floats; scores that need more digits than these have are computed with whole numbers.
    q, d = queries.astype(np.float64), data.astype(np.float64)
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    kth = np.full(len(q), -np.inf)
    queried, held = cover_tree(q), cover_tree(d)

    def bound(a: Node, b: Node) -> float:
        top = float(q[a.center] @ d[b.center]) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return top + 1e-9 * (abs(top) + (a.radius + a.norm) * (b.radius + b.norm))

    heap, count = [(-bound(queried, held), 0, queried, held)], 0
    while heap:
        top, _, a, b = heapq.heappop(heap)
        if -top < kth[a.rows].min():
            continue
        if a.children and (not b.children or a.radius >= b.radius):
            pairs = [(x, b) for x in a.children]
        elif b.children:
            pairs = [(a, y) for y in b.children]
        else:
            if exact:
                scores = q[a.rows] @ d[b.rows].T
            else:
                scores = queries[a.rows].astype(object) @ data[b.rows].astype(object).T
            for row, own in zip(a.rows.tolist(), scores, strict=True):
                at = np.flatnonzero((own >= kth[row]) & (ids[b.rows] != query_ids[row]))
                if len(at) > 4 * k and exact:
                    at = at[own[at] >= np.partition(own[at], len(at) - k)[len(at) - k]]
                if len(at):
                    found = best[row] + [(int(own[j]), int(ids[b.rows[j]])) for j in at.tolist()]
                    # A pair of leaves meets once, so every row of an id is a candidate of its own.
                    best[row] = sorted(found, key=lambda s: (-s[0], s[1]))[:k]
                    if len(best[row]) == k:
                        kth[row] = float(best[row][-1][0]) if exact else np.nextafter(float(best[row][-1][0]), -np.inf)
            continue
        for x, y in pairs:
            value = bound(x, y)
            if value >= kth[x.rows].min():
                count += 1
                heapq.heappush(heap, (-value, count, x, y))
    return best


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector`` with components floor(scale * x) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return usable.select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("vector")).distinct()


def top_k(data: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each query; both sides distinct rows ``vec_id, vector``."""
    queries = queries.select(*(F.col(c).alias(c) for c in ("vec_id", "vector")))  # columns of its own, should both be one table
    sides = {}
    counts = (
        data.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
        .join(queries.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("m")), "width")
        .select("width", F.ceil(F.col("n") / DATA_BLOCK).alias("d_parts"), F.ceil(F.col("m") / QUERY_BLOCK).alias("q_parts"))
    )
    for side, parts, other, other_parts in (("d", "d_parts", "q", "q_parts"), ("q", "q_parts", "d", "d_parts")):
        rows = (data if side == "d" else queries).withColumn("width", F.size("vector")).join(counts, "width")
        own = F.pmod(F.xxhash64("vec_id", "vector"), F.col(parts)).alias(side)
        sides[side] = rows.select("width", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_parts) - 1)).alias(other), "vec_id", "vector")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            (qs, q_ids), (ds, d_ids) = (
                (np.array(t.column("vector").to_pylist(), np.int64).reshape(t.num_rows, -1), t.column("vec_id").to_numpy()) for t in (left, right)
            )
            found = dual_search(qs, q_ids, ds, d_ids, k)
            out = [(int(i), name, score) for i, rows in zip(q_ids, found, strict=True) for score, name in rows]
        return pa.table(
            {
                "query_id": pa.array([o[0] for o in out], pa.int64()),
                "vec_id": pa.array([o[1] for o in out], pa.int64()),
                "score": pa.array([max(_LEAST, min(-_LEAST - 1, o[2])) for o in out], pa.int64()),
            }
        )

    keys = ("width", "d", "q")
    found = sides["q"].groupBy(*keys).cogroup(sides["d"].groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(data, data.filter("vec_id % 100 = 0"))


OP3_SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(d.vector AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id AND len(q.vector) = len(d.vector)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
