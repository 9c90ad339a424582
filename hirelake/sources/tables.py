"""CSV in and out, reference tables, the run ledger and versioned Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake import schema as S
from hirelake.functions import text as X
from hirelake.sources.csv_split import read_split


class NoUsableRows(Exception):
    """A user's file has no row with a title and a salary."""


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Posting CSV with every column as text and ``pos`` as the row's place; see :func:`hirelake.sources.csv_split.read_split`.

    Each file is UTF-8, with or without byte-order mark, or GB18030 if it is not valid UTF-8; ``encoding`` settles it for all.
    """
    rows = read_split(spark, path, encoding)
    cells = [F.when(~F.col(f"`{c}`").isin(V.MISSING_CELLS), F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "pos"]
    return rows.select(*cells, "pos")


def write_csv(rows: DataFrame, path: str, columns: list[str], order: str | None = None) -> None:
    """Text columns to CSV files with a header; nulls become empty cells. ``order`` sorts across the files."""
    if order:
        rows = rows.orderBy(order)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]
    rows.select(*cells).write.mode("errorifexists").option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(path)


def write_standard(rows: DataFrame, path: str, order: str | None = None) -> None:
    """The ten-column standard table as CSV."""
    write_csv(rows, path, V.STANDARD_COLUMNS, order)


def export_list(rows: DataFrame) -> DataFrame:
    """Raw postings in the fixed list layout, missing values as empty text."""
    present = set(rows.columns)
    return rows.select(*[
        (F.coalesce(F.col(c), F.lit("")) if c in present else F.lit("")).alias(c) for c in V.LIST_EXPORT_COLUMNS
    ])


def export_details(rows: DataFrame) -> DataFrame:
    """Detail records in the fixed layout, the tag list joined."""
    flat = rows.withColumn("skill_tags", X.joined_list(F.col("skill_tags")))
    present = set(flat.columns)
    return flat.select(*[
        (F.coalesce(F.col(c), F.lit("")) if c in present else F.lit("")).alias(c) for c in V.DETAIL_EXPORT_COLUMNS
    ])


def codes_of(texts: DataFrame, include_nationwide: bool = False) -> DataFrame:
    """``city, code`` of texts ``value`` that hold a JSON object of name to code."""
    pairs = texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("city", "code"))
    usable = pairs.filter((F.col("city") != "") & F.col("code").isNotNull())
    return usable if include_nationwide else usable.filter(F.col("city") != V.NATIONWIDE)


def city_codes(spark: SparkSession, path: str, include_nationwide: bool = False) -> DataFrame:
    """``city, code`` from a code file."""
    return codes_of(spark.read.text(path, wholetext=True), include_nationwide)


def filter_codes(spark: SparkSession) -> DataFrame:
    """``domain, domain_name, label, code`` of all search filters."""
    rows = [
        (domain, name, label, code)
        for domain, (name, codes) in V.FILTER_CODES.items() for label, code in codes.items()
    ]
    return spark.createDataFrame(rows, "domain string, domain_name string, label string, code string")


def publish(rows: DataFrame, root: str, name: str, options: dict[str, object] | None = None) -> str:
    """Write a new version of a table, with options of the Parquet writer, and return its path.

    Earlier versions stay, so a table may be computed from its own previous version; readers get the version they were
    given until :func:`latest` names the new one. A version counts once Spark has committed it.
    """
    path = version_path(rows.sparkSession, root, name)
    rows.write.mode("errorifexists").options(**(options or {})).parquet(path)
    return path


def version_path(spark: SparkSession, root: str, name: str) -> str:
    """Where the next version of a table goes."""
    last = latest(spark, root, name)
    number = int(last.rsplit("/v", 1)[1].split("-")[0]) + 1 if last else 1
    return f"{root}/{name}/v{number:08d}-{uuid.uuid4().hex[:8]}"


def latest(spark: SparkSession, root: str, name: str) -> str | None:
    """Path of the newest committed version, null when there is none."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(base):
        return None
    done = [
        s.getPath().toString() for s in system.listStatus(base)
        if system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done) if done else None


def publish_ledger(combos: DataFrame, runs: DataFrame, root: str) -> tuple[str, str]:
    """New versions of the two ledger tables. The previous versions stay readable while they are being replaced."""
    return publish(combos, root, "combos"), publish(runs, root, "runs")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``combos`` and ``runs`` of a ledger file; a missing, broken or differently shaped file gives empty tables."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], S.COMBOS), spark.createDataFrame([], S.RUNS)
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    data = text.select(F.try_parse_json("value").alias("data"))
    combos = data.select(F.explode(F.try_variant_get("data", "$.combos", "map<string,variant>")).alias("key", "r"))
    record = F.col("r")

    def get(row, name: str, kind: str):
        return F.try_variant_get(row, f"$.{name}", kind).alias(name)

    parts = F.split("key", r"\|")
    texts = ["family_name", "keyword", "status"]
    counts = ["raw", "new", "dup", "runs"]
    rows = combos.select(
        *[F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")).alias(c)
          for i, c in enumerate(["city", "family_id", "slice_id"], 1)],
        *[get(record, c, "string") for c in texts], *[get(record, c, "bigint") for c in counts],
        get(record, "run_at", "string"), get(record, "exit_code", "int"), get(record, "truncated", "boolean"),
    )
    listed = data.select(F.explode(F.try_variant_get("data", "$.runs", "array<variant>")).alias("r"))
    runs = listed.select(*[get(record, f.name, f.dataType.simpleString()) for f in S.RUNS.fields])
    return rows.select(*S.COMBOS.fieldNames()), runs
