"""Every query against its DuckDB oracle on the smallest tables, and its columns."""

from __future__ import annotations

import math

import duckdb
import pytest

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    try:
        return repr(float(value) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got.columns) >= 2
        return
    want = oracle.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
