"""Rows of a query in Spark and of its SQL in DuckDB, as sorted lists to compare."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect(folder: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def both(spark, query, sql: str, folder: Path = DATA) -> tuple[list, list, list, list]:
    df = query(spark, str(folder))
    found = connect(folder).execute(sql)
    names = [c[0] for c in found.description]
    return sorted(df.columns), sorted(names), rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
