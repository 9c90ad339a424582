"""Aggregates that move each row once, and combine only hot keys before the shuffle."""

import random

import pytest

from hirelake import fixed_values as V
from hirelake.operators import dedupe as D
from hirelake.operators import merge as M
from hirelake.plans import consolidation as K
from hirelake.plans import quality as Q

COLUMNS = list(dict.fromkeys([*V.DRIFT_FIELDS, "job_link", "jd"]))


@pytest.fixture(scope="module")
def listings(spark):
    draw, rows = random.Random(5), []
    for n in range(400):
        own = draw.choice(["hot", "hot", "hot", "", None, *(f" j{i}" for i in range(40))])
        rows.append((own, n, *[draw.choice(["", "-", None, "a", "bb"]) for _ in COLUMNS]))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["job_id"]) + ", pos long, " + ", ".join(f"{c} string" for c in COLUMNS)).repartition(5)


def rows_of(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


CASES = {
    "best": lambda df, n: M.best_snapshots(df, hot_rows=n),
    "incomplete": lambda df, n: M.best_snapshots(df, complete=False, hot_rows=n),
    "state": lambda df, n: K.state_of(df, df.filter("pos % 2 = 0").select("job_id", "jd", "pos"), hot_rows=n),
    "listings only": lambda df, n: K.state_of(df.drop("jd"), hot_rows=n),
    "drift": lambda df, n: Q.field_drift(df, hot_rows=n),
    "first": lambda df, n: D.first_per_key(df, ["job_id", "title"], counted=["job_id"], hot_rows=n),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_keys_make_no_difference(listings, name):
    whole = rows_of(CASES[name](listings, 10_000))
    assert whole and whole == rows_of(CASES[name](listings, 50)) == rows_of(CASES[name](listings, 0))


@pytest.mark.parametrize("name", ["best", "incomplete", "listings only"])
def test_rows_are_moved_once_and_not_sorted_before(listings, name):
    plan = CASES[name](listings, 10_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "REPARTITION_BY_COL" in plan  # the rows, and the fixture's own partitions
    assert "Sort" not in plan[plan.index("REPARTITION_BY_COL"):]


def test_ids_of_details_alone_are_kept(spark, listings):
    more = spark.createDataFrame([("only", "text", 1), (" ", "blank", 2)], "job_id string, jd string, pos long")
    row, = K.state_of(listings, more).filter("job_id = 'only'").collect()
    assert row["snapshots"] == 0 and row["best"] is None and row["detail_jd"]["jd"] == "text" and row["first"]["title"] is None
