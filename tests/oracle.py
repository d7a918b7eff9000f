"""Comparison of a Spark query with its SQL in DuckDB over the same parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value) if value is not None else "null"


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


FAMILIES = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "INTEGER": "int", "BIGINT": "bigint",
    "double": "double", "DOUBLE": "double", "string": "string", "VARCHAR": "string", "boolean": "boolean",
    "BOOLEAN": "boolean", "timestamp_ntz": "timestamp", "TIMESTAMP": "timestamp", "date": "date", "DATE": "date",
}


def difference(df, sql: str, con) -> str | None:
    """None where both agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: FAMILIES.get(str(d[1]), str(d[1])) for d in result.description}
    mine = {n: FAMILIES.get(t, t) for n, t in df.dtypes}
    if mine != types:
        return f"types: spark {sorted(mine.items())} sql {sorted(types.items())}"
    columns, expected = _table(names, result.fetchall())
    own, rows = _table(df.columns, [tuple(r) for r in df.collect()])
    if len(rows) != len(expected):
        return f"rows: spark {len(rows)} sql {len(expected)}"
    if rows != expected:
        extra = sorted(set(rows) - set(expected))[:3]
        lacking = sorted(set(expected) - set(rows))[:3]
        return f"{columns}: spark only {extra}, sql only {lacking}"
    return None
