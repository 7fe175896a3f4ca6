"""Compares a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def same(df, sf_dir: str, sql: str) -> None:
    columns, rows = duck(sf_dir, sql)
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(columns)
    want = rows_of(columns, rows)
    assert len(got) == len(want), f"{len(got)} rows, not {len(want)}"
    differ = [(g, w) for g, w in zip(got, want) if g != w]
    assert not differ, f"{len(differ)} differ, first: {str(differ[0])[:1500]}"
