import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return v


@pytest.fixture
def agree():
    """Rows of a query equal those of its SQL over the same tables."""

    def check(df, sql, sf_dir=SF, **views):
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            name = os.path.basename(p).split(".")[0]
            if name not in views:
                con.execute(f"create view {name} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
        names = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == names
        want = sorted(repr([plain(dict(zip(cols, r))[c]) for c in names]) for r in cur.fetchall())
        assert got == want
        return len(got)

    return check


@pytest.fixture
def write(spark, tmp_path):
    """Write small tables as NAME.parquet in a new folder."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
