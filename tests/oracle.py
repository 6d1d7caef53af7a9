"""Compares a query with its DuckDB statement."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(v[i]) for i in order]) for v in values)


def _plain(v):
    return float(v) if type(v).__name__ == "Decimal" else list(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    assert got == rows(rel.columns, rel.fetchall())
