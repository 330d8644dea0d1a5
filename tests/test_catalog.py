"""Every registered query against DuckDB on the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from brambling import catalog

from .conftest import DATA

#: Approximate by nature: checked for recall in test_neighbours.
ROWS_ONLY = {"knn_probed"}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(DATA / "sf0.001").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_only_approximate_queries_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_oracle(name, spark, small_dir, oracle):
    df = catalog.QUERIES[name](spark, small_dir)
    found = oracle.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = [df.columns.index(c) for c in names]
    got = sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr)
    assert [repr(r) for r in got] == [repr(r) for r in sorted(found.fetchall(), key=repr)]
