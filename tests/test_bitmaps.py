import random

import pytest

from hirelake.plans import bitmaps as B
from hirelake.plans import quality as Q

SCHEMA = "batch_path string, keyword string, batch_city string, job_id string"


def batches(seed, first, count):
    draw = random.Random(seed)
    return [(f"p{k}", draw.choice(["x", "y", "", None]), draw.choice(["a", "b", None]), draw.choice(["", " ", *(f"j{i}" for i in range(60))]))
            for k in range(first, first + count) for _ in range(draw.randrange(1, 30))]


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_equals_the_figures_over_all_postings(spark, tmp_path):
    root, every = str(tmp_path / "out"), []
    for step in range(2):
        own = batches(step, 10 * step, 5)
        # Rows of one batch have one keyword and city.
        place = {p: (k, c) for p, k, c, _ in own}
        own = [(p, *place[p], i) for p, _, _, i in own]
        every += own
        B.add_batches(spark, root, spark.createDataFrame(own, SCHEMA), bucket_rows=7)
        listings = spark.createDataFrame(every, SCHEMA)
        assert rows(B.yield_total(spark, root)) == rows(Q.yield_total(listings))
        assert rows(B.yield_overlap(spark, root)) == rows(Q.yield_overlap(listings))
        for dimension in B.DIMENSIONS:
            assert rows(B.yield_by(spark, root, dimension)) == rows(Q.yield_by(listings, dimension))
    with pytest.raises(ValueError):
        B.add_batches(spark, root, spark.createDataFrame(every[:1], SCHEMA))


def test_many_ids_and_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    B.add_batches(spark, root, spark.createDataFrame([], SCHEMA))
    assert tuple(B.yield_total(spark, root).first()) == (0, 0, 0.0)
    assert tuple(B.yield_overlap(spark, root).first()) == (0, 0.0, 0.0, 0, 0.0)
    ids = spark.range(100_000).selectExpr("concat('p', id % 3) AS batch_path", "'k' AS keyword", "'c' AS batch_city",
                                          "concat('j', id % 70000) AS job_id")
    B.add_batches(spark, root, ids)
    assert tuple(B.yield_total(spark, root).first()) == (100_000, 70_000, 70.0)
