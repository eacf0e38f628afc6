"""Date functions over texts: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that names a month or season, in the order in which it is looked for, with the month.
MONTH_WORDS = [
    ("january", 1), ("jan", 1), ("february", 2), ("feb", 2), ("march", 3), ("mar", 3), ("april", 4), ("apr", 4), ("may", 5), ("june", 6), ("jun", 6), ("july", 7), ("jul", 7), ("august", 8), ("aug", 8),
    ("september", 9), ("sep", 9), ("sept", 9), ("october", 10), ("oct", 10), ("november", 11), ("nov", 11), ("december", 12), ("dec", 12),
    ("winter", 1), ("spring", 4), ("summer", 7), ("fall", 10), ("autumn", 10),
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAMES = "|".join(MONTHS)


def iso_dates(text: Column) -> Column:
    """All ISO dates in a text, in order, repeated ones too; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1), F.array().cast("array<string>"))


def date_ranges(text: Column) -> Column:
    """All "date to date" ranges in a text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"(\d{4}-\d{2}-\d{2}\s*(?:to|until|through|–|-)\s*\d{4}-\d{2}-\d{2})"), 1), F.array().cast("array<string>"))


def month_years(text: Column) -> Column:
    """All "month year" phrases in lower case."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(rf"\b((?:{_NAMES}) \d{{4}})\b"), 1), F.array().cast("array<string>"))


def normalize_date(text: Column) -> Column:
    """The first date of a text as YYYY-MM-DD, slashes and dots allowed for hyphens; '' where there is none or it doesn't exist."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 0)
    day = F.try_to_timestamp(F.regexp_replace(found, "[/.]", "-"), F.lit("yyyy-M-d"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def parse_datetime(text: Column) -> Column:
    """A timestamp from a day with or without the time; null for anything else."""
    flat = F.regexp_replace(F.regexp_replace(text, "[/.](?=\\d)", "-"), "T|Z$", " ")
    trimmed = F.trim(flat)
    return F.coalesce(F.try_to_timestamp(trimmed, F.lit("yyyy-M-d H:m:s")), F.try_to_timestamp(trimmed, F.lit("yyyy-M-d H:m")), F.try_to_timestamp(trimmed, F.lit("yyyy-M-d")))


def day_number(text: Column) -> Column:
    """Days since 1970-01-01 of a text's first date; null where there is none."""
    return F.unix_date(F.to_date(F.nullif(normalize_date(text), F.lit(""))))


def month_of(text: Column) -> Column:
    """The month that a time of year names, 0 where it names none.

    Names are looked for as parts of the text in the order of MONTH_WORDS, so
    "mayor" names May.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(0)
    for name, month in reversed(MONTH_WORDS):
        found = F.when(F.contains(low, F.lit(name)), month).otherwise(found)
    return found


def day_count(text: Column) -> Column:
    """The first integer of a text after its ISO dates are taken out; null where there is none."""
    rest = F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}", " ")
    return F.nullif(F.regexp_extract(rest, r"(\d{1,9})", 1), F.lit("")).try_cast("int")


def as_of(query: Column) -> Column:
    """The time in a query's "As of ..., "; null where it has none."""
    return F.nullif(F.regexp_extract(query, r"(?i)\bas of ([^,?]+)[,?]", 1), F.lit(""))


def date_variants(date: Column) -> Column:
    """The ways in which an ISO date may be written: itself, spoken, with ordinals, month and year, part of the month."""
    d = F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d))
    day, year = F.dayofmonth(d), F.year(d).cast("string")
    tail = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    part = F.when(day <= 10, "early").when(day <= 20, "mid").otherwise("late")
    spoken = F.concat(month, F.lit(" "), day.cast("string"))
    forms = [
        date,
        F.concat(spoken, F.lit(", "), year),
        F.concat(spoken, F.lit(" "), year),
        F.concat(spoken, tail),
        F.concat(F.lit("the "), day.cast("string"), tail, F.lit(" of "), month),
        F.concat(day.cast("string"), F.lit(" "), month),
        F.concat(month, F.lit(" "), year),
        F.concat(part, F.lit("-"), month),
        F.concat(part, F.lit(" "), month),
    ]
    return F.when(d.isNotNull(), F.array_distinct(F.array(*forms))).otherwise(F.array().cast("array<string>"))


def mentions_date(text: Column, date: Column) -> Column:
    """Whether a text contains one of a date's variants."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(date_variants(date), lambda v: F.contains(low, v))


def month_year(text: Column) -> Column:
    """struct(year, month) of a text that names a month and year, as "2020-03" or "March 2020"; null for none."""
    iso = F.regexp_extract(text, r"\b(\d{4})-(\d{2})\b", 1)
    name = F.regexp_extract(F.lower(text), rf"\b({_NAMES}),? (\d{{4}})\b", 1)
    year = F.when(iso != "", iso).otherwise(F.regexp_extract(F.lower(text), rf"\b({_NAMES}),? (\d{{4}})\b", 2)).try_cast("int")
    month = F.when(iso != "", F.regexp_extract(text, r"\b(\d{4})-(\d{2})\b", 2).try_cast("int")).otherwise(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int"))
    return F.when(year.isNotNull() & month.between(1, 12), F.struct(year.alias("year"), month.alias("month")))


def split_range(text: Column, at_hyphens: bool = False) -> Column:
    """The two ends of a range, or the text alone.

    Ends are parted by "to", "until" or "through" as whole words, or a dash.
    With ``at_hyphens`` any "to" and any hyphen parts them, as "Oc|ber 2020".
    """
    sign = r"\s*(?:to|until|through|–|—|-)\s*" if at_hyphens else r"\s+(?:to|until|through|-)\s+|\s*[–—]\s*"
    return F.filter(F.split(F.lower(text), sign, 2), lambda x: F.length(x) > 0)
