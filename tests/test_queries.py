"""Every query that has SQL gives the rows DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import pytest

from graphloom import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: None if x is None else round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, str(SF))
    expected = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found.collect(), found.columns) == [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in plain(expected.fetchall(), expected.columns)]
