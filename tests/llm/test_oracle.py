"""Queries of this subpackage that SQL can express, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(k) for k in columns]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=repr) == want
