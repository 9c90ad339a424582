"""Registered queries against their SQL in an independent engine."""

import os

import duckdb
import pytest

from hirelake.llm.registry import LLM_ORACLE, LLM_QUERIES

SF_DIR = os.environ.get("HIRELAKE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(LLM_ORACLE))
def test_query_equals_sql(spark, checker, name):
    frame = LLM_QUERIES[name](spark, SF_DIR)
    result = checker.execute(LLM_ORACLE[name])
    names = sorted(d[0] for d in result.description)
    assert sorted(frame.columns) == names
    places = [[d[0] for d in result.description].index(n) for n in names]
    wanted = sorted(repr(tuple(r[p] for p in places)) for r in result.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in frame.collect()) == wanted
