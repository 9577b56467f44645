"""Rows of a query against the rows of its SQL."""

import math

import duckdb
from pyspark.sql import DataFrame, Row

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def sql_rows(sf: str, sql: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def assert_same(df: DataFrame, sf: str, sql: str) -> None:
    """Same column names, and the same rows in any order."""
    names, rows = sql_rows(sf, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in rows)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == want
