"""Every query with SQL against an SQL engine on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.genealogy.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(None if isinstance(v := r[i], float) and math.isnan(v) else v for i in order) for r in data]
    return [columns[i] for i in order], sorted(clean, key=lambda t: tuple((x is not None, isinstance(x, str), 0 if x is None else x) for x in t))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(SQL[name])
    want = rows([d[0] for d in r.description], r.fetchall())
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert list(a) == [pytest.approx(y, rel=1e-9, abs=1e-6) if isinstance(y, float) else y for y in b]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
