"""From raw postings to the ten-column standard table, and from that to the served table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions import labels as L
from hirelake.functions import text as X
from hirelake.functions.salary import has_salary, monthly_salary, salary_pair
from hirelake.operators.dedupe import dedupe_business, dedupe_greedy
from hirelake.operators.merge import best_snapshots, join_details
from hirelake.operators.ranking import number_rows
from hirelake.session import stored
from hirelake.sources import archive, tables


def standardize(raw: DataFrame, company: Column | None = None, fallback_city: Column | None = None,
                description: Column | None = None, keep: list[str] = ("pos",)) -> DataFrame:
    """Raw postings to standard columns; rows without a parsable salary are dropped."""
    tags = X.first_present(F.col("tags"), F.col("job_labels"))
    columns = {
        "job_name": X.text_of(F.col("title")),
        "company": X.text_of(F.col("boss_name") if company is None else company),
        "city": X.city_of(F.col("location"), fallback_city),
        "salary_low": F.col("salary_low"),
        "salary_high": F.col("salary_high"),
        "education": L.education_of_tags(tags),
        "work_years": L.experience_of_tags(tags, F.col("title")),
        "category": X.strip(F.coalesce(F.nullif(F.col("company_industry"), F.lit("")), F.lit(V.UNKNOWN))),
        "skills": X.skills_text(F.col("skills")),
        "description": F.lit("") if description is None else X.flat_text(description),
    }
    priced = raw.filter(has_salary(F.col("salary"))).transform(monthly_salary())
    return priced.select(*keep, *[c.alias(n) for n, c in columns.items()])


def import_rows(listings: DataFrame, details: DataFrame | None = None,
                keys: list[str] = ("batch_path", "job_id")) -> DataFrame:
    """Standard rows of all listings, joined with their batch's detail record when there is one.

    ``details`` has one row per key with ``detail_company`` and ``jd``. The batch city stands in for a missing place. Pass listings
    that have been written: heavy keys are counted before the join, which reads their source twice.
    """
    if details is None:
        joined = listings.drop("jd").withColumns({"detail_company": F.lit(""), "jd": F.lit("")})
    else:
        joined = join_details(listings.drop("jd"), details, list(keys))
    return standardize(
        joined,
        company=X.first_present(F.col("detail_company"), F.col("boss_name")),
        fallback_city=F.col("batch_city"),
        description=F.col("jd"),
        keep=["pos", "batch_path", "job_id"],
    )


def with_detail_path(listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Listings with the detail file of their batch. A batch is one file of bounded length, so no batch needs to be spread.

    The pairs, a row per batch file, are written first: then the planner knows their size and need not move the listings to join
    them while the pairs are few.
    """
    return listings.join(stored(pairs, "pairs"), "batch_path", "left")


def import_filter(rows: DataFrame, city: str | None = None, keyword: str | None = None) -> DataFrame:
    """Keep one city, and titles that contain a keyword (case matters)."""
    if city:
        rows = rows.filter(F.col("city") == city)
    if keyword:
        rows = rows.filter(F.contains(F.col("job_name"), F.lit(keyword)))
    return rows


def import_archive(spark: SparkSession, path: str, city: str | None = None, keyword: str | None = None,
                   pattern: str = archive.BATCH_PATTERN,
                   detail_pattern: str = archive.DETAIL_PATTERN) -> tuple[DataFrame, DataFrame]:
    """Deduplicated standard rows of an archive and the statistics per batch."""
    from hirelake.plans.quality import import_stats

    files = archive.read_files(spark, path, pattern)
    listings, batches = archive.strict_archive(files)  # parsed once; every step below reads the stored rows
    detail_files = archive.read_files(spark, path, detail_pattern)
    details = stored(archive.details(detail_files), "details")
    pairs = archive.pair_details(batches.select(F.col("batch_path").alias("path")), detail_files.select("path"))
    latest = archive.latest_details(details, ["detail_path", "job_id"]).select(
        "detail_path", "job_id", F.col("company").alias("detail_company"), "jd")
    rows = stored(import_rows(with_detail_path(listings, pairs), latest, keys=["detail_path", "job_id"]), "imported")
    # From the batch table, so that a batch without a single posting has its row, too.
    per_batch = import_stats(listings, rows, batches.select("batch_path", "keyword", "batch_city"))
    return dedupe_greedy(import_filter(rows, city, keyword)), per_batch


def merge_snapshots(listings: DataFrame) -> DataFrame:
    """Best snapshot per id, standardized, first row per business key; descriptions stay empty."""
    return dedupe_business(standardize(best_snapshots(listings)))


def merge_archive(spark: SparkSession, path: str, out: str | None = None,
                  pattern: str = archive.BATCH_PATTERN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge an archive strictly: one bad file stops it before anything is written.

    Returns the merged rows, the overview and the distributions; with ``out`` the rows are written there as the standard
    CSV table, in order of their first snapshot.
    """
    from hirelake.plans.quality import merge_distributions, merge_overview

    files = archive.read_files(spark, path, pattern)
    listings, batches = archive.strict_archive(files)
    rows = stored(merge_snapshots(listings), "merged")
    if out:
        tables.write_standard(rows, out, "pos")
    return rows, merge_overview(listings, batches), merge_distributions(rows)


def publish_consolidated(spark: SparkSession, path: str, root: str) -> dict[str, str]:
    """Consolidate what is new in an archive; see :func:`hirelake.plans.consolidation.publish`."""
    from hirelake.plans.consolidation import publish

    return publish(spark, path, root)


def alias_headers(df: DataFrame) -> DataFrame:
    """Rename known header spellings; of several spellings of one column the first filled one counts.

    Missing required columns, and the description, are added as empty text.
    """
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        sources.setdefault(V.HEADER_ALIASES.get(name, name), []).append(name)
    picked = [F.coalesce(*[F.col(f"`{s}`") for s in found]).alias(target) for target, found in sources.items()]
    missing = [F.lit("").alias(c) for c in [*V.REQUIRED_COLUMNS, "description"] if c not in sources]
    return df.select(*picked, *missing)


def clean_unnumbered(raw: DataFrame) -> DataFrame:
    """Served rows without ``job_id``: aliases, salary numbers, safe texts, first row per business key."""
    rows = alias_headers(raw)
    # Rows without a salary are told by what the parser found, not by a test before it that would read all three cells again.
    rows = rows.filter(X.safe_text(F.col("job_name"), "") != "").transform(salary_pair()).filter(F.col("salary_low").isNotNull())
    empty = {"job_name", "skills", "description"}
    texts = [c for c in V.STANDARD_COLUMNS if not c.startswith("salary_")]
    safe = {c: X.safe_text(F.col(c), "" if c in empty else V.UNKNOWN) for c in texts}
    kept = rows.select("pos", *[F.col(c) if c not in safe else safe[c].alias(c) for c in V.STANDARD_COLUMNS])
    return dedupe_business(kept).withColumns({
        "avg_salary": (F.col("salary_low") + F.col("salary_high")) / 2,
        "experience": L.experience_label(F.col("work_years")),
    })


def clean(raw: DataFrame) -> DataFrame:
    """Served table: 13 columns, numbered 1..n in the order of ``pos``."""
    return number_rows(clean_unnumbered(raw), ["pos"], "job_id").select(*V.CLEAN_COLUMNS)


def ingest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Served table of a user's CSV file; an input without usable rows is an error."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError("only CSV files are supported")
    rows = clean(tables.read_csv(spark, path))
    if rows.isEmpty():
        raise tables.NoUsableRows(f"no usable rows in {path}; check titles and salaries")
    return rows
