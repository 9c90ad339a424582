import pytest

from hirelake.llm import decontaminate
from hirelake.session import Scratch
from tests.llm import test_decontaminate


@pytest.mark.parametrize("clean", [False, True])
def test_copies_of_an_item_are_one(spark, clean):
    passage = " ".join(f"p{i}" for i in range(15))
    items = [(7, passage)] * 40 + [(None, passage.upper())] * 40 + [(8, "other item")]
    docs = [(1, f"a b {passage} c"), (2, "nothing here"), (3, "other item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    scratch = Scratch(spark, "t")
    if clean:
        made = decontaminate.clean(frame, bench, scratch, shard_words=100)
        assert [r["doc_id"] for r in made.collect()] == [2]
    else:
        made = decontaminate.find_passages(frame, bench, scratch, shard_words=100)
        found = sorted((r["id"], r["n_words"], [k for s in r["spans"] for k in range(s["start"], s["end"])], r["items"])
                       for r in made.collect())
        assert found == test_decontaminate.brute(docs, items, 13)
    # What a task collects at most: one row per name and text.
    assert spark.read.parquet(f"{scratch.path}/items-*").count() == 3
    scratch.drop()
