"""Holds queries against their SQL in DuckDB, as the driver does."""

import glob
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got_df = query(spark, sf_dir)
    columns = sorted(got_df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns, (name, want.columns, columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in got_df.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    wanted = sorted((tuple(normal(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert len(got) == len(wanted), (name, len(got), len(wanted))
    for g, w in zip(got, wanted):
        assert g == w, (name, g, w)
