"""Column jobs over captured detail pages and search responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions.text import strip, unpacked

LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_TEMP = ["__raw", "__page", "__all", "__text", "__lines", "__trimmed", "__safety_at", "__card", "__kept", "__body",
         "__reason"]


def _card(end: Column) -> Column:
    """Recruiter card that ends before line ``end`` (exclusive, zero based): struct(start, status) or null.

    The card's second-to-last line is a lone dot, the fourth-to-last the recruiter's name or activity; blank lines
    before the end do not count.
    """
    lines = F.slice(F.col("__trimmed"), F.lit(1), end)
    solid = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"\n+$", ""), "\n")
    name_or_status = F.try_element_at(solid, F.lit(-4))
    active = (name_or_status == V.ONLINE_LABEL) | name_or_status.endswith("活跃")
    start = F.size(solid) - F.when(active, 5).otherwise(4)
    status = F.when(active, name_or_status).otherwise("")
    found = (F.try_element_at(solid, F.lit(-2)) == "·") & (start >= 0)
    return F.when(found, F.struct(start.alias("start"), status.alias("status")))


def extract_descriptions(df: DataFrame, jd: str = "jd", page: str = "page_text",
                         min_length: int = V.MIN_DESCRIPTION_LENGTH) -> DataFrame:
    """Add ``description``, ``activity`` and ``reject_reason`` (null when the page is usable).

    Rejected: truncated at the login wall (``login``), navigation chrome only (``navigation``), text shorter than
    ``min_length`` after the cut (``too_short``). The recruiter card, or else the safety notice, ends the description.
    """
    raw, page_text, everything = F.col("__raw"), F.col("__page"), F.col("__all")
    text, lines, trimmed = F.col("__text"), F.col("__lines"), F.col("__trimmed")
    marker = V.DESCRIPTION_MARKER

    has_marker = everything.contains(marker)
    navigation = ~has_marker
    for word in V.NAVIGATION_WORDS:
        navigation = navigation & everything.contains(word)

    chosen = F.when((raw == "") & page_text.contains(marker), page_text).otherwise(raw)
    after = F.coalesce(F.try_element_at(F.split(chosen, marker, 2), F.lit(2)), chosen)

    competitive_at = F.array_position(trimmed, V.COMPETITIVENESS_MARKER)
    safety_at = F.col("__safety_at")
    card = F.coalesce(
        F.when(competitive_at > 0, _card((competitive_at - 1).cast("int"))),
        F.when(safety_at > 0, _card((safety_at - 1).cast("int"))),
        _card(F.size(trimmed)),
    )
    kept = (
        F.when(F.col("__card").isNotNull(), F.slice(lines, F.lit(1), F.col("__card.start")))
        .when(safety_at > 0, F.slice(lines, F.lit(1), (safety_at - 1).cast("int")))
        .otherwise(lines)
    )
    right_trimmed = F.transform(F.col("__kept"), lambda line: F.rtrim(line, F.lit(V.WHITESPACE)))
    body = strip(F.array_join(right_trimmed, "\n"))
    body = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    reason = (
        F.when(everything.contains(V.LOGIN_MARKER), "login")
        .when(navigation, "navigation")
        .when(F.length("__body") < min_length, "too_short")
    )
    usable = F.col("__reason").isNull()
    result = F.struct(
        F.when(usable, F.col("__body")).alias("description"),
        F.when(usable, F.coalesce(F.col("__card.status"), F.lit(""))).alias("activity"),
        F.col("__reason").alias("reject_reason"),
    )
    return (
        df.withColumn("__raw", F.coalesce(F.col(jd), F.lit("")))
        .withColumn("__page", F.coalesce(F.col(page), F.lit("")))
        .withColumn("__all", F.concat_ws("\n", raw, page_text))
        .withColumn("__text", F.replace(after, F.lit("\r\n"), F.lit("\n")))
        .withColumn("__lines", F.split(text, LINE_BREAK))
        .withColumn("__trimmed", F.transform(lines, strip))
        .withColumn("__safety_at", F.array_position(trimmed, V.SAFETY_MARKER))
        .withColumn("__card", card)
        .withColumn("__kept", kept)
        .withColumn("__body", body)
        .withColumn("__reason", reason)
        .withColumn("__result", result)
        .drop(*_TEMP)
        .transform(unpacked("__result", "description", "activity", "reject_reason"))
    )


def response_status(http_status: Column, body: Column) -> Column:
    """Class of a captured search response: available, unauthenticated, restricted, empty or response_error."""

    def classify(data: Column) -> Column:
        is_object = F.try_variant_get(data, "$", "map<string,variant>").isNotNull()
        code = F.try_variant_get(data, "$.code", "int")
        failed = code.isNull() | (code != 0)
        message = F.coalesce(
            F.nullif(F.try_variant_get(data, "$.message", "string"), F.lit("")),
            F.try_variant_get(data, "$.msg", "string"),
            F.lit(""),
        )
        jobs = F.try_variant_get(data, "$.zpData.jobList", "array<variant>")
        with_salary = F.exists(
            jobs, lambda job: F.coalesce(strip(F.try_variant_get(job, "$.salaryDesc", "string")), F.lit("")) != ""
        )
        return (
            F.when(~F.coalesce(is_object, F.lit(False)), "response_error")
            .when(code.isin(V.RESTRICTED_CODES), "restricted")
            .when(failed & message.rlike("|".join(V.RESTRICTED_WORDS)), "restricted")
            .when(failed, "response_error")
            .when(jobs.isNull(), "response_error")
            .when(F.size(jobs) == 0, "empty")
            .when(with_salary, "available")
            .otherwise("unauthenticated")
        )

    # The one-element array names the parsed body, so that it is parsed once.
    of_body = F.transform(F.array(F.try_parse_json(body)), classify)
    return (
        F.when(http_status == 401, "unauthenticated")
        .when(http_status.isin(403, 429), "restricted")
        .when(http_status != 200, "response_error")
        .otherwise(F.get(of_body, F.lit(0)))
    )
