"""Every query against its SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from driftlens.plans import domain, harness  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 6)
    return str(v)


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(harness.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = harness.QUERIES[name](spark, DATA)
    relation = duck.sql(harness.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())


def test_entry_module():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(harness.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names
