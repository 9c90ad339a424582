"""Keyword search that reads only files that can hold the keyword: an index of characters and character pairs.

For every published file the index knows which characters and which pairs of neighbouring characters its searched columns hold, in
upper case as the filter compares them. It is stored by pair as bitmaps of file numbers, in order of the pair. A keyword can only be
in files that hold all its pairs; those are scanned by the same filter as the whole table, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators.ranking import number_rows
from hirelake.plans.dashboard import KEYWORD_COLUMNS, apply_filters
from hirelake.sources import tables

# Code points take 21 bits; a single character is a pair with nothing behind it. The largest number is no code point: it stands
# between texts.
BITS = 21
BETWEEN = (1 << BITS) - 1


def grams_of(points: np.ndarray) -> np.ndarray:
    """Characters and pairs of neighbouring characters as numbers, sorted."""
    first = points.astype(np.int64) << BITS
    return np.unique(np.concatenate([first, first[:-1] | points[1:]]))


def _points(*texts: str) -> np.ndarray:
    coded = (t.encode("utf-32-le", "surrogatepass") for t in texts)
    return np.frombuffer(BETWEEN.to_bytes(4, "little").join(coded), dtype=np.uint32)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of each file in a batch of texts."""
    for batch in batches:
        numbers, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for number in np.unique(numbers):
            found = grams_of(_points(*(t or "" for t, n in zip(texts, numbers, strict=True) if n == number)))
            found = found[(found >> BITS != BETWEEN) & (found & BETWEEN != BETWEEN)]
            yield pa.RecordBatch.from_pydict({"file": np.full(len(found), number), "gram": found})


def index_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``gram, bucket, bits`` and ``file, path`` of a table of files. One scan of the searched columns."""
    rows = spark.read.parquet(path)
    files = number_rows(rows.select(F.col("_metadata.file_path").alias("path")).distinct(), ["path"], "file")
    columns = rows.select(F.col("_metadata.file_path").alias("path"), F.explode(F.array(
        *[F.upper(F.coalesce(c, F.lit(""))) for c in KEYWORD_COLUMNS])).alias("text"))
    texts = columns.join(files.hint("broadcast"), "path").select("file", "text")  # a row per file
    pairs = texts.mapInArrow(_grams, "file long, gram long").distinct()
    bitmaps = pairs.groupBy("gram", F.bitmap_bucket_number("file").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("file")).alias("bits"))
    return bitmaps, files


def publish(rows: DataFrame, root: str, name: str) -> str:
    """Publish a table with its index; returns the path of the version that names both. What has no such version counts for nothing."""
    spark = rows.sparkSession
    table = tables.publish(rows, root, name)
    bitmaps, files = index_of(spark, table)
    written = (table, tables.publish(bitmaps.repartitionByRange("gram").sortWithinPartitions("gram"), root, f"{name}_grams"),
               tables.publish(files, root, f"{name}_files"))
    return tables.publish(spark.createDataFrame([written], "rows string, grams string, files string"), root, f"{name}_search")


def candidates(spark: SparkSession, version: str, keyword: str) -> list[str] | None:
    """Paths of the files that hold all pairs of the keyword; None if it is blank and so matches every row."""
    keyword = (keyword or "").strip()
    if not keyword:
        return None
    paths = spark.read.parquet(version).first()
    points = _points(spark.range(1).select(F.upper(F.lit(keyword))).first()[0])
    wanted = grams_of(points) if len(points) == 1 else np.unique(points[:-1].astype(np.int64) << BITS | points[1:])
    found = spark.read.parquet(paths["grams"]).filter(F.col("gram").isin(wanted.tolist())).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter(F.col("n") == len(wanted))
    numbers = []
    for row in found.collect():  # a bit per file
        bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), dtype=np.uint8), bitorder="little")
        numbers += (np.flatnonzero(bits) + (row["bucket"] - 1) * 32768 + 1).tolist()
    files = spark.read.parquet(paths["files"]).join(spark.createDataFrame([(n,) for n in numbers], "file long"), "file", "left_semi")
    return sorted(r["path"] for r in files.collect())


def search(spark: SparkSession, version: str, params: dict[str, str]) -> DataFrame:
    """The rows of a published version that :func:`hirelake.plans.dashboard.apply_filters` keeps."""
    table = spark.read.parquet(spark.read.parquet(version).first()["rows"])
    files = candidates(spark, version, params.get("keyword", ""))
    if files is not None:
        table = spark.read.schema(table.schema).parquet(*files) if files else table.limit(0)
    return apply_filters(table, params)
