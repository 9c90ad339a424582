"""Salary parsing. Parsers that give a range are DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions.text import strip

NUMBER = r"\d+(?:\.\d+)?"
BONUS_MONTHS = r"[·•]\s*\d+\s*薪"


def _number(numbers: Column, i: int) -> Column:
    return F.get(numbers, F.lit(i)).cast("double")


def _range(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def single_salary(c: Column) -> Column:
    """First number of a salary cell, times 1000 when the text has ``k`` or ``千``. Null when there is no number."""
    text = F.lower(c)
    number = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).cast("double")
    return number * F.when(text.contains("k") | text.contains("千"), 1000.0).otherwise(1.0)


def parse_bound(value: str | float | None) -> float | None:
    """Driver-side twin of :func:`single_salary` for one request parameter."""
    import re

    text = "" if value is None else str(value).lower()
    found = re.search(r"[0-9]+(?:\.[0-9]+)?", text)
    if found is None:
        return None
    return float(found.group(0)) * (1000 if "k" in text or "千" in text else 1)


def _unpacked(df: DataFrame, ranges: Column, low: str, high: str) -> DataFrame:
    """Add the two fields of a one-element array of ranges, in place of columns of the same names.

    ``inline`` instead of plain projections: the optimizer would copy a parser that stands in a projection into every
    filter on its result. The one-element array gives each intermediate value a name, so it is computed once.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (low, high)]
    return df.select(*kept, F.inline(ranges).alias(low, high))


def salary_pair(low: str = "salary_low", high: str = "salary_high",
                text: str = "salary") -> Callable[[DataFrame], DataFrame]:
    """Replace the two salary cells by ordered numbers; fall back to the free-text column when both are missing."""

    def apply(df: DataFrame) -> DataFrame:
        free = F.lower(F.col(text)) if text in df.columns else F.lit(None).cast("string")
        cells = F.array(F.struct(single_salary(F.col(low).cast("string")).alias("a"),
                                 single_salary(F.col(high).cast("string")).alias("b"), free.alias("t")))

        def with_free(x: Column) -> Column:
            missing = x["a"].isNull() & x["b"].isNull()
            factor = F.when(x["t"].contains("k") | x["t"].contains("千"), 1000.0).otherwise(1.0)
            numbers = F.when(missing, F.regexp_extract_all(x["t"], F.lit(NUMBER), F.lit(0)))
            return F.struct(x["a"].alias("a"), x["b"].alias("b"), factor.alias("f"), numbers.alias("n"))

        def ends(x: Column) -> Column:
            first, second = _number(x["n"], 0) * x["f"], _number(x["n"], 1) * x["f"]
            return _range(F.coalesce(x["a"], x["b"], first), F.coalesce(x["b"], x["a"], second, first))

        return _unpacked(df, F.transform(F.transform(cells, with_free), ends), low, high)

    return apply


def has_salary(c: Column) -> Column:
    """Whether :func:`monthly_salary` finds a range. A test on the text alone, so that Spark can run it at the scan
    instead of repeating the whole parser there."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), BONUS_MONTHS, "").rlike(r"\d")


def has_pair(low: str = "salary_low", high: str = "salary_high", text: str = "salary",
             columns: list[str] = ()) -> Column:
    """Whether :func:`salary_pair` finds a range: any of the cells has a digit."""
    present = [c for c in (low, high, text) if c in columns]
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in present]).rlike(r"\d")


def monthly_salary(source: str = "salary", low: str = "salary_low",
                   high: str = "salary_high") -> Callable[[DataFrame], DataFrame]:
    """Parse a posting's salary text into a monthly range in yuan.

    One unit serves both ends (``8千-1.2万`` uses 万 twice); day and hour rates are scaled to a month; a reversed range
    is put in order. Null for texts without a salary.
    """

    def apply(df: DataFrame) -> DataFrame:
        raw = strip(F.col(source))
        cleaned = F.regexp_replace(F.translate(raw, "，～~", ",--"), "至", "-")
        text = F.when(~F.lower(raw).isin(V.NO_SALARY_WORDS), F.regexp_replace(cleaned, BONUS_MONTHS, ""))

        def parts(t: Column) -> Column:
            unit = F.when(t.contains("万"), 10000.0).when(t.rlike("[kK千]"), 1000.0).otherwise(1.0)
            period = (
                F.when(t.rlike(r"[天日]结|/\s*[天日]"), V.WORK_DAYS_PER_MONTH)
                .when(t.rlike(r"/\s*(?:小时|时)"), V.WORK_HOURS_PER_DAY * V.WORK_DAYS_PER_MONTH)
                .otherwise(1.0)
            )
            return F.struct(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)).alias("n"), (unit * period).alias("f"))

        def ends(x: Column) -> Column:
            first, second = _number(x["n"], 0), F.coalesce(_number(x["n"], 1), _number(x["n"], 0))
            return _range(F.round(first * x["f"], 2), F.round(second * x["f"], 2))

        return _unpacked(df, F.transform(F.transform(F.array(text), parts), ends), low, high)

    return apply


def salary_bucket(avg: Column) -> Column:
    """Histogram label of an average salary: lower edge inclusive, last bucket open. Null below zero."""
    bucket = F.when(avg < V.SALARY_EDGES[0], F.lit(None).cast("string"))
    for label, upper in zip(V.SALARY_LABELS, V.SALARY_EDGES[1:], strict=False):
        bucket = bucket.when(avg < upper, label)
    return bucket.when(avg.isNotNull(), V.SALARY_LABELS[-1])
