"""Rows of a Spark query and of its DuckDB SQL, ready to compare."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def sql_rows(con, sql):
    r = con.execute(sql)
    columns = [d[0] for d in r.description]
    return sorted(columns), rows(columns, r.fetchall())
