"""Runs a query and its SQL over the same tables and compares the rows."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(cursor, names):
    found = [x[0] for x in cursor.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = rows_of(con.execute(sql), names)
    assert len(got) == len(want) and got == want
    return len(got)
