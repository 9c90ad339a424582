"""Every registered query against its checking SQL in an independent engine, over the given tables."""

import os
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from hirelake.registry.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("HIRELAKE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows_of(names, rows):
    places = [names.index(n) for n in sorted(names)]
    return sorted(repr([round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in places]) for r in rows)


def test_every_query_has_sql_but_those_that_learn():
    assert set(QUERIES) - set(entry_module.oracle_sql()) == {"keyword_counts_segmented"}


def test_segmented_counts(spark):
    found = entry_module.queries()["keyword_counts_segmented"](spark, SF_DIR).collect()
    assert len(found) == 20 and all(r["value"] >= found[-1]["value"] for r in found)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry_module.oracle_sql()])
def test_query(spark, checker, name):
    frame = entry_module.queries()[name](spark, SF_DIR)
    result = checker.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, result.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 6
