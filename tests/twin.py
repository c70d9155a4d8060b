"""Compares a query with its SQL twin in DuckDB, as sets of rows."""

from __future__ import annotations

import os
import re

import duckdb
import pandas as pd


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def _cell(x) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
        return "NULL"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if hasattr(x, "year"):
        x = str(pd.Timestamp(x))
    try:
        return f"{float(x) + 0.0:.6f}"
    except (TypeError, ValueError):
        return re.sub(r" 00:00:00$", "", str(x))


def _column(values: pd.Series) -> list[str]:
    """The cells of a column, each distinct value written once."""
    codes, distinct = pd.factorize(values.astype(object), use_na_sentinel=False)
    cells = [_cell(x) for x in distinct]
    return [cells[i] for i in codes]


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(zip(*[_column(df[c]) for c in sorted(df.columns)], strict=True)) if len(df) else []


def assert_twin(spark, con, sf: str, query, sql: str) -> int:
    ours, theirs = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b
    return len(a)
