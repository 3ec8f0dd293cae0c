"""Comparing the rows of a DataFrame with those of a DuckDB statement."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for r in pdf.itertuples(index=False, name=None):
        rows.append(tuple("" if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(rows, key=repr)


def same_rows(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = plain(ours), plain(theirs)
    assert len(a) == len(b)
    assert a == b
