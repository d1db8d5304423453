"""Compares a query with its SQL over the same tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def agree(df, sql, sf_dir=SF) -> int:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from read_parquet('{p}')")
    names = sorted(df.columns)
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(repr([dict(zip(cols, r))[c] for c in names]) for r in cur.fetchall())
    assert got == want
    return len(got)
