"""Runs registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
from pathlib import Path

FOLDER = "/root/testdata/sf0.001"


def database():
    db = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cell = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def same(spark, name, queries, sql):
    ours, theirs = queries[name](spark, FOLDER).toPandas(), database().execute(sql[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
