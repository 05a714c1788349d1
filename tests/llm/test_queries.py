"""What is registered, and the queries that have SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from perfmine.llm.queries import ORACLES, QUERIES
from perfmine.queries.bindings import TABLES
from tools.check_oracle import rows_of

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    expected = con.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, expected.fetchall())
