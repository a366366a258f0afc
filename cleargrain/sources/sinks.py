"""Writing reports and cleaned tables, never over the raw input."""

from __future__ import annotations

import os
from collections.abc import Iterable
from urllib.parse import urlsplit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted

# Where the old table is while a new one takes its place.
PREVIOUS = ".previous"


def _location(path: str) -> tuple[str, str, tuple[str, ...]]:
    parts = urlsplit(str(path))
    if parts.scheme in ("", "file"):
        return "file", "", tuple(os.path.realpath(parts.path or str(path)).strip("/").split("/"))
    folders: list[str] = []
    for folder in parts.path.split("/"):
        if folder == "..":
            folders = folders[:-1]
        elif folder not in ("", "."):
            folders.append(folder)
    return parts.scheme, parts.netloc, tuple(folders)


def check_output(path: str, protected: Iterable[str]) -> str:
    """Refuse an output equal to, inside or around a protected input."""
    scheme, host, folders = _location(path)
    for source in protected:
        raw_scheme, raw_host, raw = _location(source)
        shared = min(len(raw), len(folders))
        if (scheme, host) == (raw_scheme, raw_host) and raw[:shared] == folders[:shared]:
            raise ValueError(f"refusing to write to {path}: it would touch the raw input {source}")
    return str(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes a path of it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def recover(spark: SparkSession, path: str) -> bool:
    """Put the previous table back where a writer was lost between the two steps of a replacement."""
    files, make = _files(spark, path)
    target, previous = make(path), make(f"{path.rstrip('/')}{PREVIOUS}")
    return not files.exists(target) and files.exists(previous) and files.rename(previous, target)


def clustered(table: DataFrame, by: Iterable[str], parts: int | None = None) -> DataFrame:
    """The rows in ranges of some columns, sorted within each, so that files and row groups hold narrow ranges.

    Rows of one key go on in the order of a hash of the whole row, so a key that holds a large share of
    the rows spans several ranges; only equal rows must stay together. Nulls come first.
    """
    keys = [quoted(c) for c in by]
    hashed = [quoted(f.name) for f in table.schema.fields if "map<" not in f.dataType.simpleString()]
    order = [*keys, F.xxhash64(*hashed)]
    dealt = table.repartitionByRange(parts, *order) if parts else table.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*keys)


def write_table(
    table: DataFrame, path: str, *, protected: Iterable[str], fmt: str = "parquet", mode: str = "overwrite", cluster_by: Iterable[str] = ()
) -> str:
    """Write in parallel, replacing what the path held before; never over a protected input.

    The new table is written beside the path and takes its place when it is complete: a failed write
    leaves the old table as it was, and readers never see a part of the new one. If the driver is lost
    between the two renames, :func:`recover` (also called by the next write and by readers that miss
    the table) puts the old one back. A table may so replace one that it is computed from. On object
    stores a rename copies and is not one step; use a table format there.

    Parquet keeps types and values as they are. CSV keeps every character of a cell, white space at
    its ends and line breaks too. Modes other than overwrite write to the path itself. With
    ``cluster_by`` the rows are written in ranges of these columns (:func:`clustered`): a filter on the
    first of them reads only the files and row groups whose range it meets.
    """
    target = check_output(path, protected)
    by = list(cluster_by)
    table = clustered(table, by) if by else table
    spark = table.sparkSession
    writer = table.write
    if fmt == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8").option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if mode != "overwrite":
        writer.mode(mode).format(fmt).save(target)
        return target
    recover(spark, target)
    files, make = _files(spark, target)
    beside = target.rstrip("/")
    staged, previous, final = make(f"{beside}.staged-{uuid4().hex}"), make(f"{beside}{PREVIOUS}"), make(target)
    try:
        writer.format(fmt).save(staged.toString())
        files.delete(previous, True)
        replaced = files.exists(final)
        if replaced and not files.rename(final, previous):
            raise OSError(f"cannot move the old table of {target} aside")
        if not files.rename(staged, final):
            if replaced:
                files.rename(previous, final)
            raise OSError(f"cannot put the new table in place at {target}")
    finally:
        files.delete(staged, True)
    files.delete(previous, True)
    return target
