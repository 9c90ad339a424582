"""Text expressions: every function maps columns to a column and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed_values as V

# White space as a Java regex class; the escapes cover the characters \s leaves out.
SPACE_CLASS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def unpacked(packed: str, *names: str) -> Callable[[DataFrame], DataFrame]:
    """Replace a struct column by its fields.

    Goes through a one-element ``inline``: a plain projection lets the optimizer copy a long expression into every
    filter on its result, once per mention, until the code no longer compiles.
    """

    def apply(df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != packed]
        return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(packed)).alias(*names))

    return apply


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends (plain ``trim`` leaves U+3000 and U+00A0)."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def text_of(c: Column) -> Column:
    """Trimmed text, empty for null."""
    return strip(F.coalesce(c, F.lit("")))


def safe_text(c: Column, default: str = V.UNKNOWN) -> Column:
    """Trimmed text; null, blank, ``nan`` and ``None`` become the default."""
    trimmed = strip(c)
    return F.when(trimmed.isNull() | trimmed.isin("", "nan", "None"), F.lit(default)).otherwise(trimmed)


def first_present(*columns: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def city_of(location: Column, fallback: Column | None = None) -> Column:
    """First segment of ``city·area·district``; else the fallback; else unknown."""
    head = strip(F.substring_index(text_of(location), "·", 1))
    options = [head] if fallback is None else [head, fallback]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(V.UNKNOWN))


def district_of(location: Column) -> Column:
    """Second segment when there are two or more, else the whole text; null for empty text."""
    value = F.coalesce(location, F.lit(""))
    return F.coalesce(F.try_element_at(F.split(value, "·"), F.lit(2)), F.nullif(value, F.lit("")))


def skills_text(skills: Column) -> Column:
    """Skills joined by commas, whatever separators they came with; blank parts dropped."""
    edge = SPACE_CLASS + V.SKILL_SEPARATORS
    joined = F.regexp_replace(F.coalesce(skills, F.lit("")), f"[{edge}]*[{V.SKILL_SEPARATORS}][{edge}]*", ",")
    return F.btrim(joined, F.lit(V.WHITESPACE + V.SKILL_SEPARATORS))


def skill_list(skills: Column) -> Column:
    """Comma list to array, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(skills, F.lit("")), ","), strip)
    return F.filter(parts, lambda s: s != "")


def flat_text(c: Column) -> Column:
    """Runs of white space become one blank; ends trimmed; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE_CLASS}]+", " "))


def contains_ignoring_case(c: Column, word: str) -> Column:
    """Literal, case-insensitive containment. Null counts as empty text."""
    return F.contains(F.upper(F.coalesce(c, F.lit(""))), F.upper(F.lit(word)))


def source_id(link: Column, title: Column) -> Column:
    """First 16 hex digits of the md5 of the link, or of the title when the link is blank."""
    return F.substring(F.md5(first_present(link, title).cast("binary")), 1, 16)


def joined_list(items: Column) -> Column:
    """Array to text with the list separator of raw postings."""
    return F.concat_ws(" | ", items)


def salary_label(salary: Column) -> Column:
    """The salary text itself when it names K or a day rate, else the no-label class."""
    value = F.coalesce(salary, F.lit(""))
    return F.when(value.contains("K") | value.contains("元/天"), value).otherwise(F.lit("未标注"))


def useful_tags(tags: Column) -> Column:
    """Drop benefit words, site noise, dots and tags shorter than 2 or longer than 15 characters."""
    pattern = "|".join([f"\\Q{w}\\E" for w in V.BENEFIT_WORDS + V.NOISE_WORDS])

    def keep(tag: Column) -> Column:
        return (tag != "...") & F.length(tag).between(2, 15) & ~tag.rlike(pattern)

    return F.filter(F.transform(tags, strip), keep)


def activity_status(detail: Column, listed: Column) -> Column:
    """Recruiter activity: the detail page's text, else the list's."""
    return first_present(text_of(detail), text_of(listed))


def listed_activity(text: Column, online: Column) -> Column:
    """Recruiter activity of a list entry: its text, else the online flag."""
    return F.coalesce(
        F.nullif(text_of(text), F.lit("")),
        F.when(F.coalesce(online, F.lit(False)), F.lit(V.ONLINE_LABEL)),
        F.lit(""),
    )
