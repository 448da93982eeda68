"""Compare a query's rows with its SQL's, run by DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x) -> str:
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(value, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "NULL"
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    return str(x)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con
