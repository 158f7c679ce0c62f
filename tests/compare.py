"""Comparing a query with its SQL, values in any order."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")


def connection():
    held = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        held.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return held


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, query, sql):
    found = query(spark, DATA)
    if sql is None:
        found.collect()
        return
    wanted = connection().sql(sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(wanted.columns, wanted.fetchall())
