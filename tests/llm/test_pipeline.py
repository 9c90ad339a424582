import gc

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirelake.llm import decontaminate, langid, packing
from hirelake.llm.registry import vocabulary
from hirelake.session import Scratch
from tests.llm import test_decontaminate, test_similar, test_substring

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items, model):
    """Rows (doc_id, text) that reach packing: every stage by its rule."""
    kept = [(i, t) for i, t in docs if model.predict(t)[0] != "und" and model.predict(t)[1] >= corpus_pipeline.LEAST_SCORE]
    first = {i for i, c in test_similar.brute(kept) if i == c}
    kept = [(i, t) for i, t in kept if i in first]
    originals = dict(kept)
    kept = [(i, originals[i] if not r else t) for i, n, r, t in test_substring.brute(kept, 13) if r < n]
    judged = zip(test_decontaminate.brute(kept, items, 13), sorted(kept), strict=True)
    return [(i, test_decontaminate.brute_cut(t, items, 13, 12)) for (i, n, hit, _), (_, t) in judged
            if not hit or 20 * len(hit) < n]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_run_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    wanted = brute(rows, items, model)
    assert 50 < len(wanted) < len(rows)
    scratch = Scratch(spark, "t")
    pieces = packing.pack(spark.createDataFrame(wanted, "doc_id long, text string"), scratch, vocabulary()).drop("ids")
    columns = ["doc_id", "doc_tokens"]
    expected = {tuple(r) for r in pieces.withColumnRenamed("id", "doc_id").select(columns).collect()}
    found = corpus_pipeline.run(spark, folder)
    assert {tuple(r) for r in found.select(columns).collect()} == expected
    assert found.agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]
    scratch.drop()


def test_benchmark_stage_leaves_no_passage(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    scratch = Scratch(spark, "t")
    before = decontaminate.find_passages(docs, items, scratch).filter(
        (F.size("items") > 0) & ~decontaminate.contaminated()).count()
    made = corpus_pipeline.benchmark(spark, docs, folder)
    over = F.exists("spans", lambda s: s["end"] - s["start"] >= decontaminate.WIDTH)
    assert before > 0 and decontaminate.find_passages(made, items, scratch).filter(over).count() == 0
    changed = made.join(docs.withColumnsRenamed({"text": "old", "n_chars": "was"}), "doc_id").filter("text <> old")
    assert 0 < changed.count() <= before and changed.filter("n_chars <> length(text) OR n_chars >= was").count() == 0
    scratch.drop()


def test_stages_can_be_chained_without_writing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made, other = docs, corpus_pipeline.near_duplicates(spark, docs.limit(50), FOLDER)
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, made, FOLDER)
    gc.collect()
    assert other.count() > 0 and made.count() > 50


ODD = [(1, None, None, None, None), (None, "der die und nicht das", "de", "s", 20), (3, "", "en", "s", 0),
       (None, "der die und nicht das", "de", "s", 20), (5, "the one and only text here", "en", "s", 3),
       (4, "the one and only text here", "en", None, 4), (4, "the one and only text here", "en", None, 4),
       (6, "12 34", "en", "s", 5), (7, "word " * 30_000, "en", "s", 150_000)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_rows_and_columns(spark, rows):
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], f"{SCHEMA}, score string, Words int")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, FOLDER)
        if name == "sequences":
            assert made.columns[0] == "doc_id"
        else:
            assert made.columns == frame.columns
            frame = spark.createDataFrame(made.collect(), frame.schema)
    ids = sorted({r["doc_id"] for r in made.collect()}, key=str)
    assert ids == ([] if not rows else [4, 7, None])
