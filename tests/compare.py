"""Run registered queries and their SQL twins on the same files and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """An empty text when both results hold the same rows."""
    spark_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    sql_rows = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns: {sorted(set(df.columns) ^ set(names))}"
    mine, theirs = rows_of(df.columns, spark_rows), rows_of(names, sql_rows)
    if mine == theirs:
        return ""
    a, b = list((mine - theirs).items()), list((theirs - mine).items())
    cols = sorted(names)
    for x, _ in a[:1]:
        near = min((y for y, _ in b), key=lambda y: sum(p != q for p, q in zip(x, y)), default=None)
        diff = [(c, p, q) for c, p, q in zip(cols, x, near or ()) if p != q]
        return f"rows {len(spark_rows)}/{len(sql_rows)}, unmatched {len(a)}/{len(b)}, e.g. {diff[:5]}"
    return f"rows {len(spark_rows)}/{len(sql_rows)}, unmatched {len(a)}/{len(b)}, e.g. {b[:1]}"
