"""Runs a query and its SQL over the same tables and compares all rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def canon(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return "" if x is None else str(x)


def same(df, sql, sf_dir):
    """Asserts that a DataFrame and SQL give the same rows, columns taken by name."""
    cur = connect(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(canon(x) for _, x in sorted(zip(names, r))) for r in cur.fetchall())
    got = sorted(tuple(canon(x) for _, x in sorted(zip(df.columns, r))) for r in df.collect())
    assert len(want) == len(got)
    for a, b in zip(got, want):
        assert a == b
    return len(got)
