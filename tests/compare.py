"""A query's rows against those of its SQL."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return v if v is None or isinstance(v, (int, str)) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names))), key=str)


def engine(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


def assert_same(spark, con, query, sql, folder):
    assert rows(query(spark, folder).toArrow()) == rows(con.execute(sql).to_arrow_table())
