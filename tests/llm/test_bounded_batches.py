import pyarrow as pa
import pytest

import corpus_pipeline
from hirelake.session import BATCH_BYTES

FOLDER = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_bound_what_a_worker_holds(spark, number):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    long = spark.range(0, 2000, 1, 1).selectExpr("concat(id, repeat(' word', 1000)) AS text")
    docs = spark.createDataFrame([(1, "the one and only text here", "en", "s", 26)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    try:
        corpus_pipeline.STAGES[number][1](spark, docs, FOLDER)
        found = long.mapInArrow(sizes, "rows long, bytes long").collect()
    finally:
        spark.conf.unset(KEY)
    assert sum(r["rows"] for r in found) == 2000 and max(r["bytes"] for r in found) <= BATCH_BYTES + (1 << 14)
