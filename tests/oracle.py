"""Holds a query against its SQL, by column name, without order."""

import math
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return tuple(v) if isinstance(v, list) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(normal(r[k]) for k in order) for r in data), key=repr)


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    assert got == expected
