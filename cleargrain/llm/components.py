"""Connected components of an undirected graph by alternating stars, on edges spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def _stored(edges: DataFrame, folder: str, step: int) -> DataFrame:
    path = f"{folder}/stars-{step}"
    edges.write.parquet(path)
    return edges.sparkSession.read.schema("u long, v long").parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of an edge (longs ``u, v``); the smallest node names a component.

    Each round links the larger neighbours of a node, then the smaller ones, to its least neighbour,
    until only stars are left: about log2 of the longest path rounds. The least neighbour is an
    aggregate joined back, so a node with very many edges is combined early and its join can be split.
    Loops and repeated edges do no harm.
    """
    folder, step = scratch_path(edges.sparkSession, "components"), 0
    edges = _stored(edges.select("u", "v").filter("u <> v").distinct(), folder, step)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _stored(large.filter("u <> v").distinct(), folder, step := step + 1)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = _stored(small, folder, step := step + 1)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("component", F.col("u"))
    return (
        leaves.union(roots).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))
    )
