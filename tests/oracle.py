"""Query results against DuckDB on the same files."""

from __future__ import annotations

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder: str = SMALL):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()]
    return sorted(rows, key=lambda r: [("" if v is None else str(v)) for v in r])


def compare(spark, db, query, sql: str, folder: str = SMALL) -> None:
    ours, theirs = query(spark, folder).toPandas(), db.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
