"""Every named query against its SQL on the smallest data set."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).tz_localize(None).isoformat()
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = _sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert df.schema.fieldNames()
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == _sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
