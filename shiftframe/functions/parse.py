"""Numbers and codes out of scraped text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(text: Column) -> Column:
    """"$1,234.50", also in quotes, as 1234.5; "-", "n/a" and other text as null."""
    return F.trim(F.regexp_replace(F.trim(text), '[$,"]', "")).try_cast("double")


def whole_money(text: Column) -> Column:
    """The digits of a text as a number; null without any."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).cast("bigint")


def height_inches(text: Column) -> Column:
    """6' 1" as 73."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d+)'\s*(\d+)", k).try_cast("bigint")
    return part(1) * 12 + part(2)


def url_id(url: Column, segment: str = "player") -> Column:
    """The number of the path segment after ``segment``, as in /player/1837; null without one."""
    return F.nullif(F.regexp_extract(url, rf"/{segment}/(\d+)(?:/|$)", 1), F.lit("")).try_cast("bigint")


def path_id(url: Column) -> Column:
    """The first path segment that is a number; null without one."""
    return F.nullif(F.regexp_extract(url, r"/(\d+)(?=/|$|\?|#)", 1), F.lit("")).try_cast("bigint")


def split_name(name: Column) -> tuple[Column, Column]:
    """The first word, and the rest ("" for one word); nulls for a blank name."""
    words = F.split(F.nullif(F.trim(F.regexp_replace(name, r"\s+", " ")), F.lit("")), " ")
    return F.element_at(words, 1), F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")


def title_case(name: Column) -> Column:
    """Dots as spaces; every run of letters gets a capital, also after an apostrophe or a hyphen."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.+", " "), r"\s+", " "))
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def abbreviation(text: Column) -> Column:
    """The first word of two or three letters, in capitals; null without one."""
    return F.nullif(F.regexp_extract(F.upper(text), r"\b([A-Z]{2,3})\b", 1), F.lit(""))


def clean_number(text: Column, kind: str = "bigint", fill: int | None = 0) -> Column:
    """The text as a number, with ``fill`` for what is none."""
    found = F.trim(text).try_cast(kind)
    return found if fill is None else F.coalesce(found, F.lit(fill).cast(kind))
