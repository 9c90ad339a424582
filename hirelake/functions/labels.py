"""Experience, education, job-family and city labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import fixed_values as V
from hirelake.functions.text import safe_text, strip

_FLOAT = r"(?i)^[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def lookup(c: Column, table: dict) -> Column:
    """Value of a fixed table, null when absent."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, c)


def experience_label(c: Column) -> Column:
    """Years as a number (``年`` allowed) to its bucket; any other text is its own label."""
    text = strip(F.replace(c, F.lit("年"), F.lit("")))
    years = F.when(text.rlike(_FLOAT), text).try_cast("double")
    return (
        F.when(years <= 0, "应届/无经验")
        .when(years <= 3, "1-3年")
        .when(years <= 5, "3-5年")
        .when(years.isNotNull(), "5年以上")
        .otherwise(safe_text(c))
    )


def experience_of_tags(tags: Column, title: Column) -> Column:
    """Bucket of the first experience label in the tags; else newcomer words in the title; else unknown."""
    found = F.regexp_extract(F.coalesce(tags, F.lit("")), "|".join(V.EXPERIENCE_BUCKETS), 0)
    newcomer = F.coalesce(title, F.lit("")).rlike("|".join(V.NEWCOMER_WORDS))
    return F.coalesce(
        lookup(found, V.EXPERIENCE_BUCKETS),
        F.when(newcomer, V.EXPERIENCE_ORDER[0]),
        F.lit(V.UNKNOWN),
    )


def education_of_tags(tags: Column) -> Column:
    """First education label in the tags, longer labels tried first; else unknown."""
    found = F.regexp_extract(F.coalesce(tags, F.lit("")), "|".join(V.EDUCATION_LABELS), 0)
    return F.when(found != "", found).otherwise(V.UNKNOWN)


def family_of_title(title: Column) -> Column:
    """Job family of a title.

    Search keywords decide first, in family order; then the wide terms in match order. The test is lower-case
    containment, one literal alternation per family, so it costs no join and no shuffle.
    """
    low = F.lower(F.coalesce(title, F.lit("")))
    label = F.when(F.lit(False), "")
    for family_id, words in [*[(f, keywords) for f, _n, keywords, _w in V.FAMILIES],
                             *[(f, V.FAMILY_TERMS[f]) for f in V.FAMILY_MATCH_ORDER]]:
        label = label.when(low.rlike("|".join(f"\\Q{w.lower()}\\E" for w in words)), family_id)
    return label.otherwise(V.OTHER_FAMILY)


def display_city(city: Column) -> Column:
    return F.coalesce(lookup(city, V.CITY_DISPLAY), city)


def city_weight(city: Column) -> Column:
    """Tier weight; the nationwide pseudo-city and unlisted cities have their own."""
    weight = F.when(city == V.NATIONWIDE, V.NATIONWIDE_WEIGHT)
    for names, tier_weight in V.CITY_TIERS.values():
        weight = weight.when(city.isin(names), tier_weight)
    return weight.otherwise(V.DEFAULT_CITY_WEIGHT)


def market_factor(city: Column) -> Column:
    return F.sqrt(city_weight(city))


def slice_label(slice_id: Column) -> Column:
    """Display label of a slice; unknown ids stand for themselves; a dash for the base search."""
    table = dict(chain.from_iterable(V.SLICES.values()))
    return F.coalesce(lookup(slice_id, table), F.nullif(slice_id, F.lit("")), F.lit("—"))


def family_name(family_id: Column) -> Column:
    return F.coalesce(lookup(family_id, {f: name for f, name, _, _ in V.FAMILIES}), family_id)
