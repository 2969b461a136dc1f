"""Compares a query with its SQL in DuckDB, as sorted rows of equal columns."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(names)
    return order, sorted((tuple(r[names.index(c)] for c in order) for r in got.fetchall()), key=str)


def rows_of_spark(df):
    order = sorted(df.columns)
    return order, sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)


def assert_same(df, sql, sf_dir):
    assert rows_of_spark(df) == rows_of_sql(sql, sf_dir)
