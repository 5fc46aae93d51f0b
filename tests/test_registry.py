"""Every registered query equals its SQL over the smallest tables, and the entry point has the contract's shape."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from flowloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(tuple(r[i] for i in place) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["channel", "members"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) == set(registry.SQL)
