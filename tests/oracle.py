"""Compare a query with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(normal(r[c]) for c in columns)) for r in frame.toArrow().to_pylist())


def sql_rows(folder, sql):
    with duckdb.connect() as db:
        for t in TABLES:
            path = f"{folder}/{t}.parquet"
            db.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        out = db.sql(sql)
        names = sorted(out.columns)
        order = [out.columns.index(c) for c in names]
        return names, sorted(repr(tuple(normal(r[k]) for k in order)) for r in out.fetchall())
