"""Runs a query and its SQL side by side."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def both(spark, folder, run, sql, database_):
    df = run(spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = database_.sql(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    return got, want
