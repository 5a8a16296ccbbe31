"""Each query of the library against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import pytest

from quaylight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value))
    return str(value.replace(tzinfo=None)) if isinstance(value, dt.datetime) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = sql.sql(registry.oracle_sql()[name])
    found = [d[0] for d in relation.description]
    assert sorted(found) == columns
    want = sorted(tuple(plain(row[found.index(c)]) for c in columns) for row in relation.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
