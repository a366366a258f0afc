"""Session settings, shared scratch space and the size check in front of every broadcast."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of at most a few hundred bytes each: a broadcast of this many stays near 100 MB.
BROADCAST_ROWS = 400_000
# Rows may be few and still hold very long texts.
BROADCAST_BYTES = 64 << 20


def configure(builder: SparkSession.Builder, *, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Settings the operators are tuned for; all can be overridden afterwards."""
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot key even where that costs one more exchange downstream.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Small exchanges hold costly rows (names to be compared, cells to be told apart): keep all cores at work.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        # Stored intermediates go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="cleargrain-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid4().hex}"


def settle(table: DataFrame) -> DataFrame:
    """Compute an intermediate result once, reliably stored.

    The files outlive lost executors, so later stages never recompute what led here. Spark removes
    them with the table if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_dir(table.sparkSession)
    return table.checkpoint(eager=True)


def broadcast_if_small(
    table: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """Settle a table and mark it for broadcast only when its counted rows and bytes allow."""
    stored = settle(table)
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in stored.columns]
    rows, total = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0))).first()
    return (F.broadcast(stored), True) if rows <= limit and total <= limit_bytes else (stored, False)
