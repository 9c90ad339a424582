from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from hirelake.llm import langid, substring

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_workers_of_a_stage_give_memory_back(spark, number):
    def kept(batches):
        """MB that a worker still holds after a task has freed its arrays, but for a few bytes between them."""
        def held():
            return sum(int(line.split()[1]) for line in Path("/proc/self/smaps_rollup").read_text().splitlines()
                       if line.startswith("Private_Dirty")) / 1024

        for batch in batches:
            np.ones(1 << 21)  # raises the size from which blocks are given back, unless it is fixed
            before, small = held(), []
            arrays = []
            for _ in range(100):
                arrays.append(np.ones(1 << 17))
                small.append(bytes(2000))
            assert held() - before > 90
            del arrays
            yield pa.RecordBatch.from_pydict({"mb": [held() - before], "pool": [pa.default_memory_pool().backend_name]})
            del small

    docs = spark.createDataFrame([(1, "the one and only text here", "en", "s", 26)], SCHEMA)
    before = dict(spark.sparkContext.environment)
    try:
        corpus_pipeline.STAGES[number][1](spark, docs, FOLDER)
        found = spark.range(0, 1, 1, 1).mapInArrow(kept, "mb double, pool string").first()
    finally:
        spark.sparkContext.environment = before
    assert found["mb"] < 20 and found["pool"] == "system"


def test_passages_takes_small_chunks(spark, monkeypatch):
    most = []
    make = substring._make_chunks
    monkeypatch.setattr(substring, "_make_chunks", lambda width, size: most.append(size) or make(width, size))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 1) for i in range(3)], SCHEMA)
    found = corpus_pipeline.passages(spark, docs, FOLDER)
    assert most == [2 << 20] and found.count() == 3


def test_the_fit_leaves_a_small_worker(monkeypatch):
    calls = []
    monkeypatch.setattr(langid, "trimmed", lambda: calls.append(1))
    at, counts = (np.array(x, dtype=np.uint32).tobytes() for x in ([1, 2, 3], [1, 1, 2]))
    group = pd.DataFrame({"lang": ["a", "b"] * 5, "mark": range(10), "at": [at] * 10, "counts": [counts] * 10})
    made = langid._fit(["a", "b"], np.ones(langid.FEATURES))(group)
    assert len(made) == 1 and calls == [1]
