"""Rows of a Spark query and of its SQL, in a form that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def of_spark(df):
    return sorted(tuple(map(plain, r)) for r in df.collect())


def of_sql(con, sql, columns):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in columns]
    return sorted(tuple(plain(row[k]) for k in at) for row in r.fetchall())
