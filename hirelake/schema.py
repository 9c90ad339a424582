"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

from hirelake.fixed_values import RAW_COLUMNS, STANDARD_COLUMNS

# Order of a raw posting: path of its batch, then its place inside the batch.
POSITION = T.StructType([T.StructField("batch_path", T.StringType()), T.StructField("idx", T.IntegerType())])

RAW_POSTING = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

STANDARD_POSTING = T.StructType([
    T.StructField(c, T.DoubleType() if c.startswith("salary_") else T.StringType()) for c in STANDARD_COLUMNS
])

CLEAN_POSTING = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("salary_low", T.DoubleType()),
    T.StructField("salary_high", T.DoubleType()),
    T.StructField("avg_salary", T.DoubleType()),
    T.StructField("education", T.StringType()),
    T.StructField("work_years", T.StringType()),
    T.StructField("experience", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("skills", T.StringType()),
    T.StructField("description", T.StringType()),
])

DETAIL = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("salary_source", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("boss_active_status", T.StringType()),
    T.StructField("tags_list", T.StringType()),
    T.StructField("job_link", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("skill_tags", T.ArrayType(T.StringType())),
    T.StructField("jd", T.StringType()),
])

# One search (city, family, slice). ``slice_id`` is "" for the base search.
COMBOS = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("family_id", T.StringType()),
    T.StructField("slice_id", T.StringType()),
    T.StructField("family_name", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("raw", T.LongType()),
    T.StructField("new", T.LongType()),
    T.StructField("dup", T.LongType()),
    T.StructField("runs", T.LongType()),
    T.StructField("run_at", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("truncated", T.BooleanType()),
])

RUNS = T.StructType([
    T.StructField("at", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("budget", T.LongType()),
    T.StructField("executed", T.LongType()),
    T.StructField("new_jobs", T.LongType()),
    T.StructField("raw", T.LongType()),
])
