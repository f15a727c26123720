"""Rows of both engines in one comparable form."""

import os

import duckdb


def plain(row):
    def one(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        if isinstance(x, (list, tuple)):
            return str([one(y) for y in x])
        return str(x)

    return tuple(map(one, row))


def views(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(plain(r) for r in df.select(*columns).collect())


def sql_rows(con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(plain([row[i] for i in order]) for row in r.fetchall())
