"""Compare registered queries with their SQL on DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return x
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, name, query, text, sf_dir, con):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(text)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], f"{name}: columns {got[0]} {want[0]}"
    assert len(got[1]) == len(want[1]), f"{name}: {len(got[1])} rows, SQL has {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, f"{name}: {len(bad)} of {len(got[1])} differ, {bad[:2]}"
    return len(got[1])
