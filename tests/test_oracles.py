"""Every registered query against its SQL oracle on the smallest test tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verification.registry import all_checks

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in queries().items() if name in all_checks()}
ORACLES = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def _sortable(row):
    return tuple((v is not None, str(type(v) is str), v) if v is not None else (False, "", 0)
                 for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted(map(_sortable, frame.select(*[f"`{c}`" for c in columns]).collect()))
    assert got, "a query over the test tables returns rows"
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(_sortable([row[i] for i in order]) for row in cursor.fetchall())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    assert entry(spark).count() > 0
