"""Compare a Spark query with its SQL on DuckDB: names, types and values, in any row order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.astype(object).where(df.notna(), "\x00").astype(str)
    return df.loc[text.sort_values(list(text.columns)).index].reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got, want = _sorted(got), _sorted(want)
    for name in got.columns:
        if got[name].dtype != want[name].dtype:
            return f"{name}: {got[name].dtype} != {want[name].dtype}"
        a, b = got[name].astype(object).where(got[name].notna()), want[name].astype(object).where(want[name].notna())
        bad = (a != b) & ~(a.isna() & b.isna())
        if bad.any():
            i = bad.idxmax()
            return f"{name} in {int(bad.sum())} rows: {got.loc[i].to_dict()} != {want.loc[i].to_dict()}"
    return None
