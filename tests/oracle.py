"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return v


def rows(records, names):
    return sorted((tuple(value(r[n]) for n in names) for r in records), key=repr)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = rows([r.asDict(True) for r in df.collect()], names)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == names
    assert got == rows([dict(zip(cols, x)) for x in res.fetchall()], names)
    return got
