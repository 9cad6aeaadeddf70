"""Compare registered queries with their SQL, as sets of rows with columns sorted by name."""

import math
from collections import Counter

import duckdb


def connection(sf_dir):
    import os

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(cell(r[k]) for k in order) for r in rows)


def compare(spark, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    return got, want, dict(df.dtypes)
