"""Comparison of a Spark result with DuckDB's result of the same question."""

import glob
import os

import duckdb
import pandas as pd


def cells(frame: pd.DataFrame) -> list:
    def cell(v):
        if v is None or not isinstance(v, str) and pd.isna(v):
            return "null"
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def answer(sql: str, sf_dir: str) -> pd.DataFrame:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db.sql(sql).df()
