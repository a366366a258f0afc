"""Reading tables and stored reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted
from ..operators.profile import ROW_ID
from ..session import broadcast_if_small
from .sinks import recover


def column_name(header: object, position: int) -> str:
    """Trimmed header, or a numbered name for a blank one (positions start at 1)."""
    text = "" if header is None else str(header).strip()
    return text or f"unnamed_column_{position:02d}"


def with_row_id(table: DataFrame, key: str | None = None) -> DataFrame:
    """Number rows by a key that orders them, which survives any file layout, or as they come.

    Without a key the number only holds for one run over one layout; readers use :func:`in_file_order`.
    """
    ordinal = quoted(key).cast("bigint") if key else F.monotonically_increasing_id()
    return table.withColumn(ROW_ID, ordinal)


def in_file_order(rows: DataFrame, place: Column) -> DataFrame:
    """Number rows from 0 by file name and by ``place``, a number that rises through each file, however files are split.

    A place is counted from the least one of its file. The rows of each file are counted in a scan
    that reads no data columns, and summed up over the files before. This is done at once; the sums,
    a row per file, are broadcast, so rows stay where they are read and a large file is not gathered in one task.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), place.alias("_place"))
    files = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_least"))
    # One row per file.
    earlier = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    shifts, _ = broadcast_if_small(files.select("_file", (earlier - F.col("_least")).alias("_shift")))
    return placed.join(shifts, "_file").select(*[quoted(c) for c in rows.columns], (F.col("_place") + F.col("_shift")).alias(ROW_ID))


def read_csv(spark: SparkSession, path: str, *, key: str | None = None) -> DataFrame:
    """Delimited text with a header line, as all-string columns.

    Short rows are padded with NULLs, long rows cut to the header's width. A quoted empty string
    stays distinct from a missing value.
    """
    # Only an unquoted empty cell turns into this marker, so a quoted empty string is kept.
    # Cells may hold line breaks, so a file is one split; many part files keep the reading parallel.
    options = {"header": False, "nullValue": "\x00missing\x00", "emptyValue": "", "escape": '"', "multiLine": True}
    header = spark.read.options(**options).csv(path).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    names = [column_name(cell, i) for i, cell in enumerate(header, start=1)]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated column names in {path}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    rows = (
        spark.read.options(**{**options, "header": True, "mode": "PERMISSIVE", "enforceSchema": True})
        .schema(schema)
        .csv(path)
    )
    # A file is read by one task from its first line to its last, so running numbers rise through it.
    return with_row_id(rows, key) if key else in_file_order(rows, F.monotonically_increasing_id())


def read_parquet(spark: SparkSession, path: str, *, key: str | None = None) -> DataFrame:
    """Typed columns under their trimmed names.

    Without a key rows are numbered by file name and by their number in the file, which does not depend on how files are split.
    """
    rows = spark.read.parquet(path)
    names = [column_name(c, i) for i, c in enumerate(rows.columns, start=1)]
    if key:
        return with_row_id(rows.toDF(*names), key)
    return in_file_order(rows, F.col("_metadata.row_index")).toDF(*names, ROW_ID)


def read_report(
    spark: SparkSession, path: str, schema: T.StructType, *, required: bool = True, fmt: str = "csv"
) -> DataFrame:
    """A stored report under a declared schema; when absent, an error or an empty table."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        if recover(spark, path):
            return reader.format(fmt).load(path)
        if required:
            raise FileNotFoundError(f"report not found: {path}; run the step that writes it first") from problem
        return spark.createDataFrame([], schema)


def head_rows(table: DataFrame, n: int = 5000, *, row_id: str = ROW_ID) -> DataFrame:
    """The first ``n`` rows in scan order."""
    if n <= 0:
        raise ValueError("the sample size must be positive")
    return table.orderBy(row_id).limit(n)


def header(table: DataFrame, *, row_id: str = ROW_ID) -> list[str]:
    """Column names, without running a job."""
    return [c for c in table.columns if c != row_id]
