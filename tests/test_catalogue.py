"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from velario.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        return
    cols = sorted(df.columns)
    rel = duck.execute(catalogue.ORACLES[name])
    heads = [d[0] for d in rel.description]
    want = [dict(zip(heads, r, strict=True)) for r in rel.fetchall()]
    assert sorted(heads) == cols
    assert sorted(tuple(cell(r[c]) for c in cols) for r in rows) == sorted(tuple(cell(r[c]) for c in cols) for r in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
