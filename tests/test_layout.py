import random
from pathlib import Path

import pyarrow.parquet as pq

from hirelake.plans import dashboard as B
from hirelake.plans import layout as Y
from hirelake.sources import tables as T

SCHEMA = "n long, city string, education string, experience string, category string, avg_salary double"


def rows_of(spark, count, seed=1):
    draw = random.Random(seed)
    made = [(k, f"city{draw.randrange(40):02}", draw.choice(["a", "b", "c"]), draw.choice("wxyz"), f"cat{draw.randrange(9)}",
             float(draw.randrange(1000, 50000))) for k in range(count)]
    return spark.createDataFrame([*made, (count, None, None, None, None, None)], SCHEMA)


def share_read(path, tests):
    """Share of row groups whose smallest and largest values admit all tests (column, low, high)."""
    groups = kept = 0
    for file in Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            kept += all(stats[c] is None or not stats[c].has_min_max or (stats[c].min <= high and stats[c].max >= low)
                        for c, low, high in tests)
    return kept / groups


def test_filters_read_few_groups_and_find_the_same(spark, tmp_path):
    rows = rows_of(spark, 40_000)
    path = Y.publish(rows, str(tmp_path / "curve"), "served", files=128)
    plain = T.publish(rows.repartition(128, "n"), str(tmp_path / "plain"), "served")
    cases = [({"city": "city07"}, [("city", "city07", "city07")], 0.7),
             ({"city": "city07", "education": "b"}, [("city", "city07", "city07"), ("education", "b", "b")], 0.5),
             ({"education": "a", "experience": "w", "category": "cat3"},
              [("education", "a", "a"), ("experience", "w", "w"), ("category", "cat3", "cat3")], 0.5),
             ({"city": "city31", "min_salary": "10000", "max_salary": "12000"}, [("city", "city31", "city31"),
                                                                                ("avg_salary", 10000.0, 12000.0)], 0.5)]
    for params, tests, most in cases:
        found = [sorted(r["n"] for r in B.apply_filters(f, params).collect()) for f in (rows, spark.read.parquet(path))]
        assert found[0] == found[1] and found[0]
        assert share_read(path, tests) < most and share_read(plain, tests) > 0.9
    assert spark.read.parquet(path).count() == 40_001


def test_bounds_and_empty_table(spark, tmp_path):
    bounds = Y.bounds_of(rows_of(spark, 500))
    assert bounds["education"] == ["b", "c"] and len(bounds["avg_salary"]) <= 31
    empty = rows_of(spark, 5).limit(0)
    assert spark.read.parquet(Y.publish(empty, str(tmp_path), "none")).count() == 0


def test_options_reach_the_writer(spark, tmp_path):
    rows = rows_of(spark, 3000)
    sizes = []
    for options in ({}, {"parquet.bloom.filter.enabled#city": "true", "parquet.bloom.filter.max.bytes": "65536"}):
        path = T.publish(rows.coalesce(1), str(tmp_path / str(len(sizes))), "t", {"compression": "uncompressed", **options})
        (file,) = Path(path).glob("*.parquet")
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "UNCOMPRESSED"
        sizes.append(file.stat().st_size)
    assert sizes[1] > sizes[0] + 30_000  # the filter is in the file
