"""Every registered query against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import catalogue

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else x
    return x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        assert got
        return
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
