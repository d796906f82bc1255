"""Every query with a SQL twin gives the same rows in Spark and in DuckDB."""

import decimal
from collections import Counter

import duckdb
import pytest

from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_twin(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert df.columns and rows is not None
        return
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in rows) == theirs
