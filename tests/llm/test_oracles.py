"""Queries against their DuckDB SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest
from test_catalog import rows_of

from foliolens.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
