"""Merging repeated snapshots of one posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions.text import text_of
from hirelake.operators.skew import HOT_ROWS, grouped, hot_keys, salted_left_join


def completeness() -> Column:
    """Score of a raw posting: field weights for usable fields, plus capped lengths of skills and tags."""
    score = F.lit(0)
    for field, weight in V.COMPLETENESS_WEIGHTS.items():
        usable = ~text_of(F.col(field)).isin("", *V.PLACEHOLDERS)
        score = score + F.when(usable, weight).otherwise(0)
    length = {c: F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("skills", "tags")}
    return score + F.least(length["skills"], F.lit(60)) + F.least(length["tags"], F.lit(40))


def with_id(df: DataFrame) -> DataFrame:
    """Rows with a non-blank id, the id trimmed. Blank ids would otherwise form one huge group."""
    return df.withColumn("job_id", text_of(F.col("job_id"))).filter(F.col("job_id") != "")


def best_snapshots(df: DataFrame, complete: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per id: the most complete snapshot, the first one on a tie.

    With ``complete`` a blank field takes the first usable value among the id's snapshots; a placeholder of the best
    snapshot stays. ``pos`` becomes the place of the first snapshot. One aggregate, one exchange of the rows as they are; the ids are
    counted before.
    """
    rows = with_id(df)
    rest = [c for c in rows.columns if c not in ("job_id", "pos")]
    order = F.struct((-F.col("__score")).alias("score"), F.col("pos").alias("pos"))
    aggregates = [F.min_by(F.struct(*rest), order).alias("__best"), F.min("pos").alias("pos"),
                  F.count(F.lit(1)).alias("snapshots")]
    fields = [f for f in V.COMPLETENESS_WEIGHTS if f in rest] if complete else []
    for field in fields:
        value = text_of(F.col(field))
        usable = ~value.isin("", *V.PLACEHOLDERS)
        first_usable = F.min(F.when(usable, F.struct(F.col("pos").alias("pos"), value.alias("value"))))
        aggregates.append(first_usable.getField("value").alias(f"__alt_{field}"))

    def reduce(part: DataFrame) -> DataFrame:
        return part.withColumn("__score", completeness()).groupBy("job_id").agg(*aggregates)

    best = grouped(rows, ["job_id"], reduce, hot_rows=hot_rows)

    def pick(c: str) -> Column:
        if c in ("job_id", "pos"):
            return F.col(c)
        value = F.col(f"__best.`{c}`")
        if c not in fields:
            return value.alias(c)
        return F.when(text_of(value) == "", F.coalesce(F.col(f"__alt_{c}"), value)).otherwise(value).alias(c)

    return best.select(*[pick(c) for c in rows.columns], "snapshots")


def longest_descriptions(*sources: DataFrame) -> DataFrame:
    """``job_id, jd``: the longest trimmed description per id over all sources; the earliest on a tie.

    Sources are ranked in the order given; each has ``job_id, jd, pos``.
    """
    ranked = None
    for rank, source in enumerate(sources):
        jd = text_of(F.col("jd"))
        rows = with_id(source).select(
            "job_id", jd.alias("jd"), "pos"
        ).filter(F.col("jd") != "")
        first = rows.groupBy("job_id").agg(
            F.min_by("jd", F.struct((-F.length("jd")).alias("l"), F.col("pos").alias("p"))).alias("jd")
        ).select("job_id", "jd", F.lit(rank).alias("source"))
        ranked = first if ranked is None else ranked.unionByName(first)
    return ranked.groupBy("job_id").agg(
        F.min_by("jd", F.struct((-F.length("jd")).alias("l"), F.col("source").alias("s"))).alias("jd")
    )


def provenance(df: DataFrame) -> DataFrame:
    """``job_id, source``: the distinct ``city|keyword|batch`` labels of each id, one row each.

    Kept as rows instead of an array: an id may occur in any number of batches.
    """
    label = F.concat_ws("|", F.coalesce("batch_city", F.lit("")), F.coalesce("keyword", F.lit("")), F.col("batch_dir"))
    return with_id(df).select("job_id", label.alias("source")).distinct()


def join_details(listings: DataFrame, details: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Listings with ``detail_company`` and ``jd`` of their detail record, null without one.

    ``details`` holds one row per key. Ids that own a large share of the listings are salted.
    """
    return salted_left_join(listings, details, keys, ["pos"], hot_keys(listings, keys, hot_rows))
