"""Every registered query of the engine against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest
from helpers import DATA

from keyloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.9g}"
    return value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    order = sorted(df.columns)
    result = duck.sql(registry.oracle_sql()[name])
    assert sorted(result.columns) == order
    at = [result.columns.index(c) for c in order]
    want = sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*order).collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
