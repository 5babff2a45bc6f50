"""Comparison of a registered query with its SQL in DuckDB, row for row."""

from __future__ import annotations

import math
import os

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str = DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _key(row: tuple) -> list:
    return [(v is None, str(type(v).__name__) if v is None else "", v if v is not None else 0) if not isinstance(v, float) else (False, "", round(v, 6)) for v in row]


def assert_same(frame, sql: str, con) -> None:
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (a, b)
