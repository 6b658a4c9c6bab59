"""Compare a Spark result with its DuckDB statement, row by row, ignoring order."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_timestamp(kind):
        return "timestamp"
    if pa.types.is_large_string(kind):
        return "string"
    return str(kind)


def _rows(table: pa.Table) -> list[str]:
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    return sorted(repr(row) for row in zip(*columns, strict=True))


def difference(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree on names, types and values, else what differs first."""
    found = con.sql(sql).to_arrow_table()
    actual = spark_df.toArrow()
    types = [{f.name: _kind(f.type) for f in t.schema} for t in (actual, found)]
    if types[0] != types[1]:
        keys = sorted(k for k in {**types[0], **types[1]} if types[0].get(k) != types[1].get(k))
        return "types: " + ", ".join(f"{k} {types[0].get(k)} / {types[1].get(k)}" for k in keys)
    left, right = _rows(actual), _rows(found)
    if len(left) != len(right):
        return f"rows: {len(left)} / {len(right)}"
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"values: {sorted(actual.column_names)}\n  {a[:1500]}\n  {b[:1500]}"
    return None
