"""Comparing a Spark result with DuckDB's, rows in any order."""

from pathlib import Path

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("~" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


def duck(sql: str, folder: str) -> pd.DataFrame:
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c.execute(sql).df()
