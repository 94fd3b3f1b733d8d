"""Date text and time-of-day helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """``dd.mm.yyyy``, ``yyyy/mm/dd`` or ISO; anything else is NULL."""
    iso = F.nullif(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    return (
        F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(text, "d.M.yyyy"))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(text, "yyyy/M/d"))
        .otherwise(iso.try_cast("date"))
    )


def month_of(text: Column) -> Column:
    """Month of a ``yyyy/mm/dd`` text."""
    return F.get(F.split(text, "/"), F.lit(1)).try_cast("int")


def is_known(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).isin("", "None", "-9999")


def date_label(first: Column, second: Column) -> Column:
    """``d (exact)``, ``d1..d2``, the one that is there, or ``-``."""
    a, b = F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))
    return (
        F.when(a.isNotNull() & (a == b), F.concat(a, F.lit(" (exact)")))
        .when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(".."), b))
        .otherwise(F.coalesce(a, b, F.lit("-")))
    )


def first_year(text: Column) -> Column:
    """First four-digit year 19xx or 20xx in a date-like text."""
    return F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def minutes_apart(a: Column, b: Column) -> Column:
    """Distance of two minutes-of-day around midnight."""
    d = F.abs(a - b)
    return F.least(d, 1440 - d)


def time_close(ts: Column, minute_of_day: Column | int, tolerance: int = 10) -> Column:
    wanted = F.lit(minute_of_day) if isinstance(minute_of_day, int) else minute_of_day
    return minutes_apart(F.hour(ts) * 60 + F.minute(ts), wanted) <= tolerance


def time_bucket(ts: Column, seconds: int = 90) -> Column:
    """Fallback orbit key of a pass: its time of day in buckets (halves go to the even bucket)."""
    tod = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int")
    return F.concat(F.lit("tod"), F.bround(tod / seconds).cast("int").cast("string"))
