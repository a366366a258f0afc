"""Run a registered query and its SQL on the same files and compare names, types and values."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(rows, order):
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_KINDS = {
    "BIGINT": "int", "INTEGER": "int", "HUGEINT": "int", "VARCHAR": "text", "DOUBLE": "float", "BOOLEAN": "bool",
    "TIMESTAMP": "time", "TIMESTAMP_NTZ": "time", "STRING": "text", "INT": "int", "DATE": "date",
}


def differences(df, con, statement: str) -> list[str]:
    """Human-readable differences, none when query and SQL agree."""
    spark_types = {f.name: _KINDS.get(f.dataType.simpleString().upper(), f.dataType.simpleString()) for f in df.schema}
    done = con.execute(statement)
    sql_types = {d[0]: _KINDS.get(str(d[1]).upper(), str(d[1])) for d in done.description}
    expected = done.fetchall()
    if set(spark_types) != set(sql_types):
        return [f"columns differ: {sorted(set(spark_types) ^ set(sql_types))}"]
    found = [f"type of {c}: {spark_types[c]} vs {sql_types[c]}" for c in spark_types if spark_types[c] != sql_types[c]]
    names = sorted(spark_types)
    mine, theirs = list(spark_types), list(sql_types)
    got = _rows([tuple(r) for r in df.collect()], [mine.index(n) for n in names])
    want = _rows(expected, [theirs.index(n) for n in names])
    if got != want:
        extra, lacking = list((got - want).elements()), list((want - got).elements())
        found.append(f"{len(extra)} extra and {len(lacking)} lacking of {sum(want.values())} rows; columns {names}")
        found += [f"  extra {r}"[:900] for r in sorted(extra, key=str)[:2]] + [f"  lacking {r}"[:900] for r in sorted(lacking, key=str)[:2]]
    return found
