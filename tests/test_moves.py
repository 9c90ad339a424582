"""Rows that are moved, or read, no more often than needed."""

from hirelake.operators import dedupe as D
from hirelake.plans import standard as S


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_first_row_of_a_key_without_a_place_is_whole(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("b", 2, "later"), ("b", 1, "first"), ("b", None, "none"), (None, 3, "null")],
                                 "k string, pos long, text string")
    first = D.first_per_key(rows, ["k"])
    assert sorted(map(tuple, first.collect()), key=str) == [("a", None, "x"), ("b", 1, "first"), (None, 3, "null")]
    assert "SortAggregate" not in plan_of(first) and "WindowGroupLimit" in plan_of(first)


def test_cells_are_not_read_for_a_salary_before_they_are_parsed(spark):
    cells = [(1, "a", "12k", None, None), (2, "b", None, None, "8-9k"), (3, "c", "x", "", "none"), (4, " ", "5", None, None)]
    raw = spark.createDataFrame(cells, "pos int, job_name string, salary_low string, salary_high string, salary string")
    made = S.clean_unnumbered(raw)
    assert sorted((r["pos"], r["salary_low"], r["salary_high"]) for r in made.collect()) == [(1, 12000.0, 12000.0), (2, 8000.0, 9000.0)]
    assert "concat_ws" not in plan_of(made)
