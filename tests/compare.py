"""Run queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [
        tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False, name=None)
    ]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    """Column classes after conversion; all-NULL columns have none."""
    out = {}
    for c in df.columns:
        seen = {
            "bool" if isinstance(v, bool) else type(v).__name__.removesuffix("64")
            for v in df[c].dropna().tolist()
        }
        out[c] = "/".join(sorted(seen))
    return out


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    mine = spark_df.toPandas().astype(object)
    theirs = con.execute(sql).df().astype(object)
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(mine.columns) ^ set(theirs.columns))}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        cols = sorted(mine.columns)
        x, y = wrong[0]
        cells = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"{len(wrong)} of {len(a)} rows, e.g. {cells} in {x}"
    return None
