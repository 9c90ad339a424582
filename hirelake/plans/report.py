"""Report over listed postings and their detail records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions import text as X
from hirelake.functions.pages import extract_descriptions
from hirelake.functions.tokens import term_rows
from hirelake.operators.ranking import value_counts
from hirelake.session import stored


def _tags(listings: DataFrame) -> DataFrame:
    return listings.select(F.explode(F.split(F.coalesce("tags", F.lit("")), r" \| ")).alias("tag"))


def salary_labels(listings: DataFrame, limit: int = 15) -> DataFrame:
    return value_counts(listings, X.salary_label(F.col("salary")), limit)


def experience_tags(listings: DataFrame) -> DataFrame:
    marked = _tags(listings).filter(F.col("tag").rlike("|".join(V.REPORT_EXPERIENCE_MARKS)))
    return value_counts(marked, F.col("tag"))


def education_tags(listings: DataFrame) -> DataFrame:
    return value_counts(_tags(listings).filter(F.col("tag").isin(V.REPORT_EDUCATION_LABELS)), F.col("tag"))


def districts(listings: DataFrame, limit: int = 10) -> DataFrame:
    named = listings.select(X.district_of(F.col("location")).alias("d")).filter(F.col("d").isNotNull())
    return value_counts(named, F.col("d"), limit)


def companies(listings: DataFrame, limit: int = 10) -> DataFrame:
    return value_counts(listings.filter(F.coalesce("boss_name", F.lit("")) != ""), F.col("boss_name"), limit)


def skill_tags(details: DataFrame, limit: int = 25) -> DataFrame:
    """Frequency of the detail pages' skill tags."""
    return value_counts(details.select(F.explode("skill_tags").alias("tag")), F.col("tag"), limit)


def frequent_terms(details: DataFrame, limit: int = 60, at_least: int = 2) -> DataFrame:
    """Most frequent description terms: the first ``limit`` by count, of those the ones seen often enough."""
    return value_counts(term_rows(details), F.col("name"), limit).filter(F.col("value") >= at_least)


def keyword_words(keyword: str) -> list[str]:
    """Words of two or more characters of a search keyword."""
    import re

    return [w for w in re.split(r"[\s,，、]+", keyword) if len(w) >= 2]


def terms(details: DataFrame, keyword: str = "") -> DataFrame:
    """``name, source, ord``: base terms, then keyword words, then frequent terms; a term stands where it comes first."""
    spark = details.sparkSession
    fixed = [(t, 0, i) for i, t in enumerate(V.BASE_TERMS)]
    fixed += [(t, 1, i) for i, t in enumerate(keyword_words(keyword))]
    listed = spark.createDataFrame(fixed, "name string, source int, ord int")
    frequent = frequent_terms(details).agg(  # at most 60 entries
        F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), "name"))).alias("t")
    ).select(F.posexplode("t.name").alias("ord", "name")).select("name", F.lit(2).alias("source"), "ord")
    both = listed.unionByName(frequent)
    return both.groupBy("name").agg(F.min(F.struct("source", "ord")).alias("at")).select(
        "name", F.col("at.source").alias("source"), F.col("at.ord").alias("ord"))


def term_document_counts(details: DataFrame, keyword: str = "", limit: int | None = 25) -> DataFrame:
    """``name, value, pct``: details whose description contains a term, case ignored, and their share.

    The term list is bounded (base and keyword terms plus at most 60), so it is fetched once and tested as constants
    inside the scan; a row yields the terms it has, and one entry without a name that counts the row itself.
    """
    names = [r["name"] for r in terms(details, keyword).select("name").collect()]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lower(F.lit(n)).alias("low")) for n in names])
    body = F.lower(F.coalesce("jd", F.lit("")))
    own = F.filter(listed, lambda t: F.contains(F.col("b"), t["low"]))["name"]
    entries = details.select(body.alias("b")).select(F.explode(F.concat(own, F.array(F.lit(None).cast("string")))).alias("name"))
    counts = entries.groupBy("name").agg(F.count(F.lit(1)).alias("value"))
    every = Window.partitionBy()  # one row per term of the bounded list
    total = F.max(F.when(F.col("name").isNull(), F.col("value"))).over(every)
    shares = counts.withColumn("total", total).filter(F.col("name").isNotNull()).select(
        "name", "value", F.round(F.col("value") * 100.0 / F.col("total"), 0).alias("pct")).orderBy(F.desc("value"), "name")
    return shares if limit is None else shares.limit(limit)


def dominant(listings: DataFrame, details: DataFrame, keyword: str = "") -> DataFrame:
    """``kind, ord, name``: leading skills, description terms, experience and education.

    With fewer than three valid skill tags the description terms stand in for the skills.
    """
    def numbered(kind: str, counts: DataFrame, limit: int) -> DataFrame:
        order = Window.orderBy(F.desc("value"), "name")  # over at most ten rows
        return counts.limit(limit).select(F.lit(kind).alias("kind"), F.row_number().over(order).alias("ord"), "name")

    skills = stored(numbered("skill", skill_tags(details, 10), 10), "leading-skills")
    words = stored(numbered("term", term_document_counts(details, keyword, 10), 10), "leading-terms")
    valid = (F.length("name") >= 2) & ~F.col("name").isin(list(V.NOISE_WORDS))
    enough = skills.agg((F.count_if(valid) >= 3).alias("enough")).scalar()
    return (
        skills.filter(enough).unionByName(words.filter(~enough).withColumn("kind", F.lit("skill")))
        .unionByName(words.filter(F.col("ord") <= 8))
        .unionByName(numbered("experience", experience_tags(listings), 1))
        .unionByName(numbered("education", education_tags(listings), 1))
    )


def detail_records(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Detail records: listing fields joined with the usable pages of the same link.

    ``pages`` has ``job_link, jd, page_text, tags``; one row per link on either side.
    """
    usable = extract_descriptions(pages).filter(F.col("reject_reason").isNull()).select(
        "job_link", F.col("description").alias("jd"), "activity", X.useful_tags(F.col("tags")).alias("skill_tags"))
    joined = listings.drop("jd").join(usable, "job_link")

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return joined.select(
        text("job_id").alias("job_id"), text("title").alias("title"), text("boss_name").alias("company"),
        text("salary").alias("salary"), text("salary_source").alias("salary_source"),
        text("location").alias("location"),
        X.activity_status(F.col("activity"), F.col("boss_active_status")).alias("boss_active_status"),
        text("tags").alias("tags_list"), text("job_link").alias("job_link"), text("job_link").alias("link"),
        "skill_tags", "jd")


def posting_report(listings: DataFrame, details: DataFrame | None = None, keyword: str = "") -> dict[str, DataFrame]:
    """All sections of the report."""
    sections = {
        "salary": salary_labels(listings),
        "experience": experience_tags(listings),
        "education": education_tags(listings),
        "district": districts(listings),
        "company": companies(listings),
    }
    if details is not None:
        sections |= {
            "skills": skill_tags(details),
            "terms": term_document_counts(details, keyword),
            "dominant": dominant(listings, details, keyword),
        }
    return sections
