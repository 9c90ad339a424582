"""Filters, distributions and look-ups over the served table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions.salary import parse_bound, salary_bucket
from hirelake.functions.text import contains_ignoring_case, safe_text, skill_list
from hirelake.functions.tokens import keyword_rows
from hirelake.operators.ranking import counts_by_dimension, fixed_order_counts, value_counts
from hirelake.session import stored
from hirelake.sources.tables import write_csv

DIMENSIONS = ("city", "education", "experience", "category")
KEYWORD_COLUMNS = ("job_name", "company", "category", "skills", "description")
# Counts are cut to this many names; education and experience are not cut.
TOP = {"city": 10, "category": 10, "company": 8}


def apply_filters(df: DataFrame, params: Mapping[str, str] | None = None) -> DataFrame:
    """Exact dimension filters, one literal keyword over five columns, and average-salary bounds.

    Blank parameters do not filter. All conditions end up in one filter next to the scan.
    """
    params = params or {}

    def value(name: str) -> str:
        return str(params.get(name) or "").strip()

    for name in DIMENSIONS:
        if value(name):
            df = df.filter(F.col(name) == value(name))
    if value("keyword"):
        hit = F.lit(False)
        for name in KEYWORD_COLUMNS:
            hit = hit | contains_ignoring_case(F.col(name), value("keyword"))
        df = df.filter(hit)
    low, high = parse_bound(params.get("min_salary")), parse_bound(params.get("max_salary"))
    if low is not None:
        df = df.filter(F.col("avg_salary") >= low)
    if high is not None:
        df = df.filter(F.col("avg_salary") <= high)
    return df


def top_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    return value_counts(df, safe_text(F.col(column)), limit)


def salary_histogram(df: DataFrame) -> DataFrame:
    """Six labels in order, empty ones included."""
    return fixed_order_counts(df, salary_bucket(F.col("avg_salary")), V.SALARY_LABELS, keep_empty=True)


def experience_counts(df: DataFrame) -> DataFrame:
    """Labels in fixed order; empty labels and labels outside the list are left out."""
    return fixed_order_counts(df, F.col("experience"), V.EXPERIENCE_ORDER, keep_empty=False)


def skill_counts(df: DataFrame, limit: int | None = 12) -> DataFrame:
    return value_counts(df.select(F.explode(skill_list(F.col("skills"))).alias("name")), F.col("name"), limit)


def keyword_counts(df: DataFrame, limit: int = 20) -> DataFrame:
    """Skills plus description words."""
    return value_counts(keyword_rows(df), F.col("name"), limit)


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, average salary, distinct cities and categories, most frequent skill.

    One scan: each row gives an entry for itself, its city, its category and every skill; the entries are counted with a
    map-side combine, and the figures follow from the counts.
    """
    def entry(dim: str, name: Column, amount: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), name.alias("name"), amount.alias("amount"))

    nothing = F.lit(None).cast("double")
    own = F.array(entry("row", F.lit(""), F.col("avg_salary")), entry("city", F.col("city"), nothing),
                  entry("category", F.col("category"), nothing))
    skills = F.transform(skill_list(F.col("skills")), lambda s: entry("skill", s, nothing))
    counts = df.select(F.inline(F.concat(own, skills))).groupBy("dim", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))

    def of(dim: str, value: Column) -> Column:
        return F.when(F.col("dim") == dim, value)

    rows = F.coalesce(F.sum(of("row", F.col("n"))), F.lit(0))
    rank = of("skill", F.struct((-F.col("n")).alias("n"), F.col("name").alias("name")))
    return counts.agg(
        rows.alias("total_jobs"),
        F.coalesce(F.round(F.sum("amount") / F.nullif(rows, F.lit(0)), 2), F.lit(0.0)).alias("avg_salary"),
        F.count(of("city", F.col("name"))).alias("city_count"),
        F.count(of("category", F.col("name"))).alias("category_count"),
        F.coalesce(F.min_by(F.col("name"), rank), F.lit("无")).alias("top_skill"),
    )


def distributions(df: DataFrame) -> DataFrame:
    """``dim, name, value`` of city, category, company, education, experience and salary bucket in one scan."""
    counts = counts_by_dimension(df, {
        "city": safe_text(F.col("city")),
        "category": safe_text(F.col("category")),
        "company": safe_text(F.col("company")),
        "education": safe_text(F.col("education")),
        "experience": F.col("experience"),
        "salary": salary_bucket(F.col("avg_salary")),
    }, TOP)
    return counts.filter((F.col("dim") != "experience") | F.col("name").isin(V.EXPERIENCE_ORDER))


def options(df: DataFrame) -> DataFrame:
    """``dim, ord, name``: values to choose from, sorted by name; experience in its fixed order."""
    ranks = F.array_position(F.array(*[F.lit(x) for x in V.EXPERIENCE_ORDER]), F.col("name"))
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(d).alias("name")) for d in ("city", "education", "experience", "category")
    ])
    known = (F.col("dim") != "experience") | F.col("name").isin(V.EXPERIENCE_ORDER)
    order = F.when(F.col("dim") == "experience", ranks).otherwise(0)
    return (
        df.select(F.inline(pairs)).distinct().filter(known)
        .select("dim", order.cast("int").alias("ord"), "name").orderBy("dim", "ord", "name")
    )


def clamp_limit(value: object, default: int = 10, maximum: int = 100) -> int:
    """Page size from a request parameter: a whole number within 1..maximum, else the default."""
    try:
        wanted = int(value)
    except (TypeError, ValueError):
        wanted = default
    return max(1, min(wanted, maximum))


def job_page(df: DataFrame, limit: int = 12) -> DataFrame:
    """First rows in table order."""
    return df.orderBy("job_id").limit(limit)


def first_page(rows: DataFrame, limit: int = 12) -> DataFrame:
    """The first rows of a table that is not numbered yet, numbered: a top-k by ``pos``, no sort of the whole table."""
    first = rows.orderBy("pos").limit(limit)
    numbers = F.row_number().over(Window.orderBy("pos"))  # over ``limit`` rows
    return first.withColumn("job_id", numbers).select(*V.CLEAN_COLUMNS)


def job_by_id(df: DataFrame, job_id: int) -> DataFrame:
    """The row with a serving id, from the unfiltered table; empty when there is none.

    A published table lies in order of the id, so that reading it touches the one file that can hold the row.
    """
    return df.filter(F.col("job_id") == job_id)


def export_frame(df: DataFrame, params: Mapping[str, str] | None = None) -> DataFrame:
    """Filtered rows with display headers."""
    return apply_filters(df, params).select(*[F.col(c).alias(h) for c, h in V.EXPORT_HEADERS.items()])


def export_rows(df: DataFrame, params: Mapping[str, str] | None, path: str) -> None:
    """Write the filtered rows with display headers as CSV, in order of the serving id."""
    frame = export_frame(df, params)
    write_csv(frame, path, frame.columns, V.EXPORT_HEADERS["job_id"])


def data_source(df: DataFrame, name: str) -> DataFrame:
    """Name of the source and its number of rows."""
    return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("source"), "count")


def dashboard(df: DataFrame, params: Mapping[str, str] | None = None, limit: object = 10) -> dict[str, DataFrame]:
    """All parts of the dashboard over the filtered table. The counts by dimension come from one stored scan."""
    rows = apply_filters(df, params)
    counts = stored(distributions(rows), "distributions")

    def part(dim: str) -> DataFrame:
        return counts.filter(F.col("dim") == dim).select("name", "value").orderBy(F.desc("value"), "name")

    def in_order(dim: str, labels: list[str]) -> DataFrame:
        order = rows.sparkSession.createDataFrame(list(enumerate(labels)), "ord int, name string")
        return order.join(part(dim), "name", "left").select("ord", "name", F.coalesce("value", F.lit(0)).alias("value"))

    return {
        "summary": summary(rows),
        "salary": in_order("salary", V.SALARY_LABELS),
        "education": part("education"),
        "experience": in_order("experience", V.EXPERIENCE_ORDER).filter(F.col("value") > 0),
        "city": part("city"),
        "category": part("category"),
        "skills": skill_counts(rows),
        "keywords": keyword_counts(rows, 20),
        "top_companies": part("company"),
        "jobs": job_page(rows, clamp_limit(limit)),
    }
