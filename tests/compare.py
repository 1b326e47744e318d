"""Compare a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when both sides have the same columns and the same bag of rows."""
    want = con.execute(sql)
    want_columns, want_rows = _rows([d[0] for d in want.description], want.fetchall())
    columns, rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if len(rows) != len(want_rows):
        return f"{len(rows)} rows != {len(want_rows)}"
    bad = [(a, b) for a, b in zip(rows, want_rows) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
