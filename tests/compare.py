"""Rows of a DataFrame against rows of a DuckDB query, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    return str(value)


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def same_rows(df, sql: str, folder: str) -> None:
    con = connect(folder)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in cursor.fetchall())
    ours = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert len(ours) == len(theirs)
    assert ours == theirs
