"""Data-quality profiles of an archive: batches, duplicates, drift, yield, merge and consolidation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions.text import text_of
from hirelake.functions.salary import has_salary
from hirelake.operators.merge import best_snapshots, with_id
from hirelake.operators.ranking import counts_by_dimension, top_per_group, value_counts
from hirelake.operators.skew import HOT_ROWS, grouped


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; a zero whole counts as one."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def import_stats(listings: DataFrame, rows: DataFrame, batch_table: DataFrame) -> DataFrame:
    """Per batch: raw and converted postings, those skipped for lack of a salary, those with a description.

    Of a description only whether it is empty counts; a flag in its place saves moving texts.
    """
    raw = listings.groupBy("batch_path").agg(F.count(F.lit(1)).alias("raw"))
    done = rows.groupBy("batch_path").agg(F.count(F.lit(1)).alias("converted"), F.count_if(F.col("description") != "").alias("with_jd"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("raw", "converted", "with_jd")}
    return (
        batch_table.join(raw, "batch_path", "left").join(done, "batch_path", "left")
        .select("batch_path", F.coalesce("keyword", F.lit("")).alias("keyword"),
                F.coalesce("batch_city", F.lit("")).alias("city"), *zero.values())
        .withColumn("skipped_no_salary", F.col("raw") - F.col("converted"))
    )


def import_overview(rows: DataFrame) -> DataFrame:
    """``section, name, value``: rows and mean salaries, top cities, industries and education, all experience labels."""
    means = rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("salary_low"), 2).alias("mean_low"),
                     F.round(F.avg("salary_high"), 2).alias("mean_high"))
    totals = means.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in ("rows", "mean_low", "mean_high")
    ])))
    counts = counts_by_dimension(rows, {c: F.col(c) for c in ("city", "category", "education", "work_years")},
                                 {"city": 8, "category": 5, "education": 6})
    return totals.unionByName(counts.select(F.col("dim").alias("section"), "name", F.col("value").cast("double").alias("value")))


def merge_overview(listings: DataFrame, batch_table: DataFrame) -> DataFrame:
    """One row: keywords and cities of the batches, rows with id, distinct ids, mean repeats, and what the merge drops.

    ``batch_table`` has a row per batch file (``keyword, batch_city``), so that a batch without postings counts.
    """
    from hirelake.plans.standard import standardize

    named = with_id(listings)
    scope = batch_table.agg(
        F.count_distinct(F.coalesce(F.nullif("keyword", F.lit("")), F.lit("?"))).alias("keywords"),
        F.count_distinct(F.coalesce(F.nullif("batch_city", F.lit("")), F.lit("?"))).alias("cities"),
    )
    totals = named.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_with_id"), F.count(F.lit(1)).alias("unique_ids"))
    merged = standardize(best_snapshots(listings))
    per_key = merged.groupBy(*V.BUSINESS_KEY).agg(F.count(F.lit(1)).alias("n"), F.min_by("skills", "pos").alias("skills"))
    final = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("valid"), F.count(F.lit(1)).alias("final"),
                        F.count_if(F.col("skills") != "").alias("with_skills"))
    packed = final.select(F.struct("*")).scalar()  # one pass for three figures
    both = scope.select(F.struct("*")).scalar()
    row = totals.select(both["keywords"].alias("keywords"), both["cities"].alias("cities"), "*",
                        *[packed[c].alias(c) for c in ("valid", "final", "with_skills")])
    return row.select(
        "keywords", "cities", "raw_with_id", "unique_ids",
        F.round(F.col("raw_with_id") / F.greatest("unique_ids", F.lit(1)), 1).alias("mean_repeats"),
        (F.col("unique_ids") - F.col("valid")).alias("skipped_no_salary"),
        "valid", "final", (F.col("valid") - F.col("final")).alias("removed_by_key"),
        percent(F.col("with_skills"), F.col("final"), 0).alias("with_skills_pct"),
    )


def merge_distributions(rows: DataFrame) -> DataFrame:
    """``section, name, value`` of merged standard rows: rows, distinct cities and industries, mean salaries; the largest
    cities, industries and education labels, all experience labels."""
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("city").alias("cities"),
                     F.count_distinct("category").alias("industries"), F.round(F.avg("salary_low"), 0).alias("mean_low"),
                     F.round(F.avg("salary_high"), 0).alias("mean_high"))
    totals = sizes.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("section"), F.lit(c).alias("name"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value"))
        for c in sizes.columns
    ])))
    counts = counts_by_dimension(rows, {c: F.col(c) for c in ("city", "category", "education", "work_years")},
                                 {"city": 12, "category": 8, "education": 6})
    return totals.unionByName(counts.select(F.col("dim").alias("section"), "name", F.col("value").cast("double").alias("value")))


def duplicate_profile(listings: DataFrame) -> DataFrame:
    """One row: postings, those without id, distinct ids, distinct four-field keys, those without a salary."""
    job_id = text_of(F.col("job_id"))
    key = F.struct(text_of(F.col("title")), text_of(F.col("boss_name")),
                   text_of(F.substring_index("location", "·", 1)), text_of(F.col("salary")))
    return listings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(job_id == "").alias("without_id"),
        F.count_distinct(F.nullif(job_id, F.lit(""))).alias("distinct_ids"),
        F.count_distinct(key).alias("distinct_keys"),
        F.count_if(text_of(F.col("salary")).isin("", *V.PLACEHOLDERS)).alias("without_salary"),
    )


def repeats(listings: DataFrame) -> DataFrame:
    """``job_id, n, pos``: occurrences of each id and its first place."""
    return with_id(listings).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))


def repeat_histogram(listings: DataFrame, limit: int = 12) -> DataFrame:
    """Ids by number of occurrences, fewest first."""
    per_id = with_id(listings).groupBy("job_id").agg(F.count(F.lit(1)).alias("times"))
    return per_id.groupBy("times").agg(F.count(F.lit(1)).alias("ids")).orderBy("times").limit(limit)


def field_drift(listings: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``field, rows``: rows of repeated ids whose value differs from the id's first snapshot.

    Rows shrink to the distinct versions of each id first, so an id with very many snapshots costs its versions only.
    """
    fields = V.DRIFT_FIELDS

    def reduce(part: DataFrame) -> DataFrame:
        trimmed = part.select("job_id", "pos", *[text_of(F.col(c)).alias(c) for c in fields])
        return trimmed.groupBy("job_id", *fields).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))

    versions = grouped(with_id(listings).select("job_id", "pos", *fields), ["job_id"], reduce, hot_rows=hot_rows)
    first = F.first(F.struct(*fields)).over(Window.partitionBy("job_id").orderBy("pos"))
    compared = versions.select("n", *fields, first.alias("first"))
    totals = compared.agg(*[F.sum(F.when(F.col(c) != F.col(f"first.{c}"), F.col("n"))).alias(c) for c in fields])
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("rows")) for c in fields])
    return totals.select(F.inline(entries)).filter(F.col("rows") > 0).orderBy(F.desc("rows"), "field")


def drift_samples(listings: DataFrame, ids: int = 3, snapshots: int = 4, values: int = 3) -> DataFrame:
    """``job_id, times, field, values`` for the first repeated ids: differing values of their first snapshots."""
    chosen = repeats(listings).filter(F.col("n") > 1).orderBy("pos").limit(ids).select("job_id", F.col("n").alias("times"))
    rows = with_id(listings).join(F.broadcast(chosen), "job_id")  # ``ids`` rows
    first = top_per_group(rows, ["job_id"], [F.asc("pos")], snapshots)
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), text_of(F.col(c)).alias("value")) for c in V.DRIFT_FIELDS
    ])
    listed = (
        first.select("job_id", "times", "rank", F.inline(fields)).groupBy("job_id", "times", "field")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("seen"))  # at most ``snapshots`` values
    )
    distinct = F.array_distinct(F.col("seen.value"))
    return listed.filter(F.size(distinct) > 1).select(
        "job_id", "times", "field", F.array_join(F.slice(distinct, 1, values), " / ").alias("values"))


def batch_dimensions(batch_table: DataFrame, cities: int = 10, keywords: int = 20) -> DataFrame:
    """``dim, name, value``: most frequent cities and keywords over batches that state them (object payloads)."""
    stated = batch_table.filter("is_object")
    dimensions = {"city": F.coalesce("batch_city", F.lit("?")), "keyword": F.coalesce("keyword", F.lit("?"))}
    return counts_by_dimension(stated, dimensions, {"city": cities, "keyword": keywords}).orderBy("dim", F.desc("value"), "name")


def yield_total(listings: DataFrame) -> DataFrame:
    """One row: rows with id, distinct ids, their share in percent."""
    totals = with_id(listings).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("job_id").alias("distinct_ids"))
    return totals.select("*", percent(F.col("distinct_ids"), F.col("records")).alias("yield_pct"))


def yield_by(listings: DataFrame, dimension: str) -> DataFrame:
    """Per value of a batch dimension: all rows, distinct ids, their ratio in percent. Values without ids are left out.

    The rows are reduced to (value, id) counts on the map side first, so a hot value is spread over its ids.
    """
    name = F.coalesce(F.col(dimension), F.lit("?"))
    pairs = listings.groupBy(name.alias("name"), text_of(F.col("job_id")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    per_value = pairs.groupBy("name").agg(
        F.sum("n").alias("records"), F.count_if(F.col("id") != "").alias("distinct_ids"))
    return per_value.filter(F.col("distinct_ids") > 0).withColumn(
        "yield_pct", percent(F.col("distinct_ids"), F.col("records")))


def yield_overlap(listings: DataFrame) -> DataFrame:
    """One row: mean keywords and cities per id, ids met under several keywords (count and percent)."""
    marks = F.array(F.struct(F.lit("keyword").alias("dim"), F.coalesce("keyword", F.lit("?")).alias("name")),
                    F.struct(F.lit("city").alias("dim"), F.coalesce("batch_city", F.lit("?")).alias("name")))
    pairs = with_id(listings).select("job_id", F.inline(marks)).distinct()
    per_id = pairs.groupBy("job_id").agg(
        F.count_if(F.col("dim") == "keyword").alias("keywords"), F.count_if(F.col("dim") == "city").alias("cities"))
    totals = per_id.agg(F.count(F.lit(1)).alias("ids"), F.sum("keywords").alias("k"), F.sum("cities").alias("c"),
                        F.count_if(F.col("keywords") > 1).alias("multi_keyword_ids"))
    return totals.select(
        "ids",
        F.round(F.coalesce("k", F.lit(0)) / F.greatest("ids", F.lit(1)), 2).alias("mean_keywords"),
        F.round(F.coalesce("c", F.lit(0)) / F.greatest("ids", F.lit(1)), 2).alias("mean_cities"),
        "multi_keyword_ids",
        percent(F.col("multi_keyword_ids"), F.col("ids"), 0).alias("multi_keyword_pct"),
    )


def batch_quality(listings: DataFrame) -> DataFrame:
    """``batch_path, usable``: a batch is usable when a row has title, salary, link and an API salary."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    good = filled("title") & filled("salary") & filled("job_link") & F.coalesce(F.col("salary_source") == "api",
                                                                                F.lit(False))
    return listings.groupBy("batch_path").agg(F.bool_or(good).alias("usable"))


def unpriced(listings: DataFrame) -> DataFrame:
    """One row: postings with and without a parsable salary."""
    priced = F.count_if(has_salary(F.col("salary")))
    return listings.agg(priced.alias("priced"), (F.count(F.lit(1)) - priced).alias("unpriced"))
