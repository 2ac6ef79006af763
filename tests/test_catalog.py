"""Every registered query against its DuckDB SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from foliolens.plans import catalog

SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF_ORACLE).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    # event rules are a fixpoint with priorities, promotion a greedy choice: test_mechanisms.py holds the queries against loops
    assert catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys() == {"story_events", "promoted_runs"} and catalog.ORACLE_SQL.keys() <= catalog.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_ORACLE)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
