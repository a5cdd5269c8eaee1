"""Comparing a query with its SQL, as multisets of rows by sorted column name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float) and x == 0:
        return 0.0
    return list(map(plain, x)) if isinstance(x, list | tuple) else x


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def oracle(sf_dir, sql, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    found = con.execute(sql)
    return as_rows([c[0] for c in found.description], found.fetchall())


def collected(df):
    return as_rows(df.columns, [tuple(r) for r in df.collect()])
