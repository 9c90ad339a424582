"""Training corpus from raw documents: language, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; it is written and read again as the next stage's ``docs``. All
stages but the last return the columns of ``documents``. Rows with null texts go with the first stage (they have no letter).
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import decontaminate, langid, packing, similar, substring
from hirelake.llm.columns import free
from hirelake.llm.registry import vocabulary
from hirelake.session import Scratch, bounded_batches, freeing_workers, shared_path, shuffles_removed

# A document goes only if its language cannot be told at all, or hardly better than by chance: the best score must exceed
# chance by this share of what is left up to 1.
MARGIN = 1 / 15


def least_score(languages: int) -> float:
    """The score that tells a language among so many; a single one is always told."""
    chance = 1 / max(1, languages)
    return chance + MARGIN * (1 - chance)


# For four languages: 0.3.
LEAST_SCORE = least_score(4)
# Texts per bucket in which the near-duplicate stage keeps its rows.
BUCKET_BYTES = 16 << 20
# Texts that one task of the passages stage takes apart at a time. A chunk's words and windows take some thirty times their bytes.
CHUNK_BYTES = 2 << 20

# From documents that stay, benchmark passages of more words than this are cut out.
LONGEST = decontaminate.WIDTH - 1


def _small_workers(spark: SparkSession) -> None:
    """All stages share an executor's Python workers, so that each must be small when the next stage begins."""
    bounded_batches(spark)
    freeing_workers(spark)


def _release(scratch: Scratch) -> None:
    if scratch.spark.sparkContext._jsc is not None:
        scratch.drop()


def _held(result: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``result``, still read from ``scratch``: the folder goes when no one holds the frame any more. A frame holds the one it was
    made from, so stages may be chained without writing; hold the last stage's frame until it is written."""
    result.made_from = docs
    weakref.finalize(result, _release, scratch).atexit = False
    return result


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language has a score below ``least_score``.

    Null, empty and letterless texts go. Rows without an id, or with a repeated one, are judged by their texts like any other; a
    score equal to the bound stays. Without learnable rows no language is known and no row is left, as in an empty table.
    """
    _small_workers(spark)
    learnable = docs.filter(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    lang, score = free(docs.columns, "lang_pred", "score")
    model = langid.fit(learnable)
    told = langid.predict(docs, model, docs.columns, names=(lang, score))
    least = least_score(len(model.languages))
    return told.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest ``doc_id`` of each group linked by similarity (null ids last; one of equal ids).

    Groups are linked by SimHash fingerprints and completed by an exact filter, see ``similar``. Texts without a word, null ones
    among them, are one group. An empty table stays empty.
    """
    _small_workers(spark)
    scratch = Scratch(spark, "stage-neardup")
    (row,) = free(docs.columns, "row")
    size = docs.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).repartition(buckets, row)
    with shuffles_removed(spark):
        rows = scratch.bucketed(numbered, "rows", buckets, row)
    found = similar.near_duplicates(rows, scratch, id_col=row)
    names = rows.select(F.col(row).alias("id"), F.col("doc_id"))
    first = found.join(names, "id").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("id"))).alias("first"))
    kept = scratch.table(first.select(F.col("first.id").alias(row)), "kept")
    # The kept numbers grow with the documents, so they are never broadcast, whatever their size is now.
    return _held(rows.join(kept.hint("merge"), row, "left_semi").drop(row), docs, scratch)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that an earlier document has; a document of which nothing is left goes.

    Rows of equal ids do not take words from each other, a null id comes after all others. Texts without a repeated passage stay
    as they are, null and empty ones too. An empty table stays empty.
    """
    _small_workers(spark)
    others = [c for c in docs.columns if c != "text"]
    words, removed, left = free(docs.columns, "words", "removed", "left")
    scratch = Scratch(spark, "stage-passages")
    found = substring.keep_first_passages(docs, scratch, others, chunk_bytes=CHUNK_BYTES,
                                          names=(words, removed, left), as_is=True)
    found = found.filter((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    changed = {"text": F.col(left)}
    if "n_chars" in others:
        length = F.length(left).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col(removed) > 0, length).otherwise(F.col("n_chars"))
    return _held(found.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns]), docs, scratch)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: one word in twenty or more lies in a benchmark window. Passages of more than ``LONGEST``
    words are cut out of the others, so that no text that stays holds a whole window of that length.

    Rows are judged by their texts alone; null and empty texts stay. An empty table, or benchmark, changes nothing.
    """
    _small_workers(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scratch, (before,) = Scratch(spark, "stage-benchmark"), free(docs.columns, "before")
    found = decontaminate.clean(docs.withColumn(before, F.length("text")), items, scratch, longest=LONGEST)
    changed = {}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.length("text") != F.col(before), length).otherwise(F.col("n_chars"))
    return _held(found.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns]), docs, scratch)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences. A null text is an empty one: its only token is the end. Repeated rows and rows
    without an id are documents of their own. An empty table gives no rows."""
    _small_workers(spark)
    scratch = Scratch(spark, "stage-packing")
    pieces = packing.pack(docs, scratch, vocabulary())
    return _held(pieces.withColumnRenamed("id", "doc_id").drop("ids"), docs, scratch)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("benchmark", benchmark),
    ("sequences", sequences),
]

# Trained models, 64-bit XXHash and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        del made  # and with it the stage's scratch folder
        docs = spark.read.parquet(path)
    return docs
