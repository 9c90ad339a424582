"""Word extraction from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions.text import skill_list

CJK = r"\u4e00-\u9fff"
WORDS = rf"[A-Za-z][A-Za-z0-9+#.-]*|[{CJK}]{{2,}}"
# A CJK character is a word character, so no boundary lies between it and a Latin letter.
LATIN_TERMS = r"(?U)\b[A-Za-z][A-Za-z0-9._-]+\b"
CJK_TERMS = rf"[{CJK}]{{2,6}}"


def words(text: Column) -> Column:
    """Latin words and runs of two or more CJK characters, stop words included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def tokens(text: Column) -> Column:
    """Words of a text without stop words, in order."""
    return F.filter(words(text), lambda w: ~w.isin(V.STOP_WORDS))


def keyword_rows(df: DataFrame, skills: str = "skills", text: str = "description",
                 segmenter=words) -> DataFrame:
    """One row ``name`` per skill and per description word. Stop words are words of the text, never skills."""
    listed = F.transform(skill_list(F.col(skills)), lambda s: F.struct(s.alias("name"), F.lit(True).alias("skill")))
    spoken = F.transform(segmenter(F.col(text)), lambda w: F.struct(w.alias("name"), F.lit(False).alias("skill")))
    return (
        df.select(F.explode(F.concat(listed, spoken)).alias("k"))
        .select("k.name", "k.skill")
        .filter(F.col("skill") | ~F.col("name").isin(V.STOP_WORDS))
        .select("name")
    )


def term_rows(df: DataFrame, text: str = "jd") -> DataFrame:
    """One row ``name`` per report term: Latin words of 2-30 characters, CJK runs cut at six."""
    body = F.coalesce(F.col(text), F.lit(""))
    latin = F.regexp_extract_all(body, F.lit(LATIN_TERMS), F.lit(0))
    cjk = F.regexp_extract_all(body, F.lit(CJK_TERMS), F.lit(0))
    return (
        df.select(F.explode(F.concat(latin, cjk)).alias("name"))
        .filter((F.length("name") <= 30) & ~F.col("name").isin(V.REPORT_STOP_WORDS))
    )
