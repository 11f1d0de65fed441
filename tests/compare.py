"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def from_sql(sql: str, sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return rows_of([c[0] for c in cur.description], cur.fetchall())


def assert_same(df, sql: str, sf_dir: str = SF_DIR) -> None:
    names, got = rows_of(df.columns, df.collect())
    expected_names, expected = from_sql(sql, sf_dir)
    assert names == expected_names
    assert len(got) == len(expected), (len(got), len(expected), [r for r in got if r not in set(expected)][:2], [r for r in expected if r not in set(got)][:2])
    different = [(a, b) for a, b in zip(got, expected) if a != b]
    assert not different, different[:3]
