"""Exact distinct counts that add up: yields per city and keyword from stored bitmaps of ids.

Every id has a number for good. A batch is stored as the set of its ids' numbers, 32768 of them to a bitmap, beside its counts of
rows. Unions of bitmaps give distinct ids of any set of batches, so adding a batch reads that batch and the ids' numbers, and no
figure reads a posting again. The numbers lie in buckets of the id, which joins with new batches do not move.
"""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.text import text_of
from hirelake.operators.ranking import number_rows
from hirelake.plans.consolidation import bucketed, write_bucketed
from hirelake.plans.quality import percent
from hirelake.session import stored
from hirelake.sources import tables

# Ids per bucket of the numbers; one that has outgrown twice as many is dealt anew.
BUCKET_ROWS = 1_000_000
DIMENSIONS = ["keyword", "batch_city"]
BATCH = ["batch_path", *DIMENSIONS]


def add_batches(spark: SparkSession, root: str, listings: DataFrame, bucket_rows: int = BUCKET_ROWS) -> str:
    """Adds the postings (``batch_path, keyword, batch_city, job_id``) of batches not added before; returns the path of the new
    manifest, which names all parts. Parts without a manifest count for nothing.

    Blank ids count as rows only; a blank keyword or city is ``?`` if it is null. A batch path that is there already is an error.
    """
    newest = tables.latest(spark, root, "yields")
    last = spark.read.parquet(newest).first() if newest else None
    rows = stored(listings.select("batch_path", *[F.coalesce(c, F.lit("?")).alias(c) for c in DIMENSIONS],
                                  text_of(F.col("job_id")).alias("job_id")), "batches")
    if last and not rows.select("batch_path").distinct().join(
            spark.read.parquet(*last["counts"]).select("batch_path").distinct(), "batch_path", "left_semi").isEmpty():
        raise ValueError("some of these batches have been added before")
    pairs = rows.groupBy(*BATCH, "job_id").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy(*BATCH).agg(F.sum("n").alias("records"),
                                       F.coalesce(F.sum(F.when(F.col("job_id") != "", F.col("n"))), F.lit(0)).alias("with_id"))
    ids = pairs.filter("job_id <> ''").select("job_id").distinct()
    written = {name: tables.version_path(spark, root, name) for name in ("numbers", "counts", "bitmaps")}
    with ExitStack() as opened:
        buckets, size = (last["buckets"], last["ids"]) if last else (None, 0)
        known = opened.enter_context(bucketed(spark, last["numbers"], buckets)) if last else None
        fresh = ids if known is None else ids.join(known.hint("merge"), "job_id", "left_anti")
        fresh = number_rows(fresh, ["job_id"], "number").select("job_id", (F.col("number") + size).alias("number"))
        fresh = stored(fresh, "fresh")
        added = fresh.count()
        every = fresh if known is None else known.unionByName(fresh.repartition(buckets, "job_id"))
        if buckets is None or size + added > 2 * bucket_rows * buckets:
            buckets = max(1, -(-(size + added) // bucket_rows))
            every = every.repartition(buckets, "job_id")
        write_bucketed(every, written["numbers"], buckets)
    with bucketed(spark, written["numbers"], buckets) as numbers:
        placed = pairs.filter("job_id <> ''").join(numbers.hint("merge"), "job_id")
        placed.groupBy(*BATCH, F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")).write.parquet(written["bitmaps"])
    counts.write.parquet(written["counts"])
    parts = {name: [*(last[name] if last else []), written[name]] for name in ("counts", "bitmaps")}
    manifest = spark.createDataFrame([(written["numbers"], buckets, size + added, parts["counts"], parts["bitmaps"])],
                                     "numbers string, buckets int, ids long, counts array<string>, bitmaps array<string>")
    return tables.publish(manifest, root, "yields")


def _parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``counts`` and ``bitmaps`` of all batches."""
    last = spark.read.parquet(tables.latest(spark, root, "yields")).first()
    return spark.read.parquet(*last["counts"]), spark.read.parquet(*last["bitmaps"])


def _united(bitmaps: DataFrame, *by: str) -> DataFrame:
    """One bitmap per group and bucket."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def yield_total(spark: SparkSession, root: str) -> DataFrame:
    """One row: rows with id, distinct ids, their share in percent."""
    counts, bitmaps = _parts(spark, root)
    ids = _united(bitmaps).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")).scalar()
    return counts.agg(F.coalesce(F.sum("with_id"), F.lit(0)).alias("records")).select(
        "records", ids.alias("distinct_ids")).withColumn("yield_pct", percent(F.col("distinct_ids"), F.col("records")))


def yield_by(spark: SparkSession, root: str, dimension: str) -> DataFrame:
    """Per value of a batch dimension: all rows, distinct ids, their ratio in percent. Values without ids are left out."""
    counts, bitmaps = _parts(spark, root)
    records = counts.groupBy(F.col(dimension).alias("name")).agg(F.sum("records").alias("records"))
    distinct = _united(bitmaps, dimension).groupBy(F.col(dimension).alias("name")).agg(
        F.sum(F.bitmap_count("bits")).alias("distinct_ids"))
    return records.join(distinct, "name").select("name", "records", "distinct_ids", percent(
        F.col("distinct_ids"), F.col("records")).alias("yield_pct"))


def _twice(table: pa.Table) -> pa.Table:
    """Ids of one bucket in any, and in two or more, of its bitmaps."""
    once, twice = np.zeros(4096, dtype=np.uint8), np.zeros(4096, dtype=np.uint8)
    for bits in table["bits"]:
        own = np.frombuffer(bits.as_py(), dtype=np.uint8)
        twice |= once & own
        once |= own
    return pa.table({"ids": [int(np.bitwise_count(once).sum())], "more": [int(np.bitwise_count(twice).sum())]})


def yield_overlap(spark: SparkSession, root: str) -> DataFrame:
    """One row: mean keywords and cities per id, ids met under several keywords (count and percent)."""
    bitmaps = _parts(spark, root)[1]
    places = {c: _united(bitmaps, c).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")).scalar() for c in DIMENSIONS}
    seen = _united(bitmaps, "keyword").groupBy("bucket").applyInArrow(_twice, "ids long, more long").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ids", "more")])
    ids = F.greatest("ids", F.lit(1))
    return seen.select(
        "ids", F.round(places["keyword"] / ids, 2).alias("mean_keywords"), F.round(places["batch_city"] / ids, 2).alias("mean_cities"),
        F.col("more").alias("multi_keyword_ids"), percent(F.col("more"), F.col("ids"), 0).alias("multi_keyword_pct"))
