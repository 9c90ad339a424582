"""Counts, top-N and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import Scratch, stored


def value_counts(df: DataFrame, c: Column, limit: int | None = None) -> DataFrame:
    """``name, value`` by count descending, then name. With a limit this plans as a top-k, not as a full sort."""
    counts = (
        df.groupBy(c.alias("name")).agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), F.asc("name"))
    )
    return counts if limit is None else counts.limit(limit)


def counts_by_dimension(df: DataFrame, dimensions: dict[str, Column], limits: dict[str, int]) -> DataFrame:
    """``dim, name, value`` of several dimensions in one scan; those with a limit are cut to their most frequent names.

    Each row is expanded once per dimension and combined on the map side. The ranking keeps only the best names of each
    task before its shuffle; a dimension without a limit is ranked name by name, that is, not at all.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("name")) for d, c in dimensions.items()])
    counts = df.select(F.inline(pairs)).groupBy("dim", "name").agg(F.count(F.lit(1)).alias("value"))
    limited = F.col("dim").isin(list(limits))
    alone = counts.withColumn("__group", F.when(~limited, F.coalesce("name", F.lit(""))))
    best = top_per_group(alone, ["dim", "__group"], [F.desc("value"), F.asc("name")], max(limits.values()))
    cut = ~limited
    for dim, n in limits.items():
        cut = cut | ((F.col("dim") == dim) & (F.col("rank") <= n))
    return best.filter(cut).select("dim", "name", "value")


def fixed_order_counts(df: DataFrame, c: Column, labels: list[str], keep_empty: bool) -> DataFrame:
    """``ord, name, value`` for a fixed list of labels; other values are ignored.

    One aggregate row holds a counter per label, so nothing is shuffled but partial counters.
    """
    one_row = df.select(c.alias("v")).agg(*[F.count_if(F.col("v") == label).alias(f"n{i}")
                                            for i, label in enumerate(labels)])
    entries = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("name"), F.col(f"n{i}").alias("value"))
        for i, label in enumerate(labels)
    ])
    rows = one_row.select(F.inline(entries))
    return rows if keep_empty else rows.filter(F.col("value") > 0)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], limit: Column | int,
                  rank: str = "rank", at_most: int | None = None) -> DataFrame:
    """First rows per group. With a whole number as limit, or as ``at_most`` beside a limit that differs by row, Spark keeps
    only the best rows of each task before it shuffles, so hot groups are safe."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    if at_most is not None:
        numbered = numbered.filter(F.col(rank) <= at_most)
    return numbered.filter(F.col(rank) <= limit)


def number_rows(df: DataFrame, order: list[str], name: str, scratch: Scratch | None = None,
                kept: list[str] | None = None) -> DataFrame:
    """Global numbers 1..n in the given order, without pulling the rows into one task; of the columns, those ``kept``.

    Rows are range-partitioned and sorted, and each partition's numbers start after the sizes of those before it. The
    sorted rows are written first, so that a recomputed task cannot meet other partition bounds.
    """
    slot = F.lit((1 << 33) - 1)  # the 33 low bits of monotonically_increasing_id count inside a partition
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", 33))
        .withColumn("__slot", F.col("__row").bitwiseAND(slot))
    )
    ranged = ranged.drop("__row") if kept is None else ranged.select(*kept, "__part", "__slot")
    placed = (scratch.table if scratch else stored)(ranged, "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return (
        placed.join(F.broadcast(starts), "__part")  # as many rows as there are partitions
        .withColumn(name, F.col("__start") + F.col("__slot") + 1)
        .drop("__part", "__slot", "__start")
    )
