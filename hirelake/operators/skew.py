"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks, one for each so many rows.
HOT_ROWS = 1_000_000
# Keys are counted in so many groups by their hash, so what is counted does not grow with the number of keys.
HASHES = 1 << 16


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``__h, __salts``: hashes of keys with at least ``hot_rows`` rows, and over how many tasks to deal them; None if there is
    no such key.

    The counts are combined on the map side. There are at most (rows / ``hot_rows``) hot keys, a few bytes each.
    """
    return _told(df.groupBy(F.xxhash64(*keys).alias("__h")).agg(F.count(F.lit(1)).alias("n")), hot_rows)


def hot_of(counts: DataFrame, keys: list[str], rows: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The same from a table that has the number of rows of each key."""
    return _told(counts.select(F.xxhash64(*keys).alias("__h"), F.col(rows).alias("n")), hot_rows)


def _told(counts: DataFrame, hot_rows: int) -> DataFrame | None:
    found = [(r["__h"], -(-r["n"] // hot_rows)) for r in counts.filter(F.col("n") >= hot_rows).collect()]
    return counts.sparkSession.createDataFrame(found, "__h long, __salts long") if found else None


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str],
                     hot: DataFrame | None) -> DataFrame:
    """Left join against a side that is unique per key; ``hot`` comes from :func:`hot_keys`.

    Rows of hot keys are dealt over tasks by the columns in ``spread_by``; only the few matching right rows are copied, once
    per task of their key. The list of hot keys is small by its making, so it is broadcast. Without hot keys this is the
    plain join.
    """
    if hot is None:
        return left.join(right, keys, "left")
    salts = F.coalesce("__salts", F.lit(1).cast("long"))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), F.xxhash64(*[df[k] for k in keys]) == hot["__h"], "left").drop("__h")

    salted = marked(left).withColumn("__salt", F.pmod(F.xxhash64(*spread_by), salts)).drop("__salts")
    copied = marked(right).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__salts")
    return salted.join(copied, [*keys, "__salt"], "left").drop("__salt")


def _hashed(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(HASHES))


def hot_hashes(df: DataFrame, counted: list[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Groups of the keys by their hash that have at least ``hot_rows`` rows; see :func:`grouped`."""
    counts = df.groupBy(_hashed(counted).alias("__h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_rows)
    return [r["__h"] for r in counts.collect()]  # at most (rows / ``hot_rows``)


def grouped(df: DataFrame, keys: list[str], reduce: Callable[[DataFrame], DataFrame], counted: list[str] | None = None,
            hot_rows: int = HOT_ROWS, hot: list[int] | None = None) -> DataFrame:
    """``reduce``, an aggregate by ``keys``, over rows that are moved once and sorted once, behind the shuffle.

    An aggregate that keeps texts or structs sorts its rows before the shuffle, too, which writes all of them to disk once more where
    few rows share a key. Only keys with at least ``hot_rows`` rows need that combine; they are told by the number of rows per hash
    of ``counted``, some of the keys that are cheap to compute, and a hash that is hot by many small keys costs only time. ``hot`` are
    these hashes where they are known.
    """
    counted = keys if counted is None else counted
    hot = hot_hashes(df, counted, hot_rows) if hot is None else hot
    if not hot:
        return reduce(df.repartition(*keys))
    hashed = _hashed(counted)
    return reduce(df.filter(~hashed.isin(hot)).repartition(*keys)).unionByName(reduce(df.filter(hashed.isin(hot))))
