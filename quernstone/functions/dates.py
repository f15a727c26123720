"""Calendar helpers: strict days, ages, market days."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_day(text: Column) -> Column:
    """The day that a text of the form YYYY-MM-DD names; null for anything else."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.length(text) == 10), text)
    return F.try_to_date(shaped, "yyyy-MM-dd")


def age_days(as_of: Column, day: Column) -> Column:
    return F.datediff(as_of, day)


def period_days(start: Column, end: Column) -> Column:
    """Length of a period that includes both ends."""
    return F.datediff(end, start) + 1


def continues(start: Column, previous_end: Column) -> Column:
    """Does a period begin on the day after the one before it ended?"""
    return start == F.date_add(previous_end, 1)


def market_day(stamp: Column, zone: str = "Asia/Shanghai") -> Column:
    """The calendar day of a UTC timestamp in the market's zone."""
    return F.to_date(F.from_utc_timestamp(stamp, zone))


def day_of_millis(millis: Column, zone: str = "Asia/Shanghai") -> Column:
    return market_day(F.timestamp_millis(millis), zone)


def latest_of(*days: Column) -> Column:
    """The latest known day; nulls do not count."""
    return F.greatest(*days)


def stamp_of(text: Column, pattern: str = "dd/MM/yyyy HH:mm") -> Column:
    """The time that a text of exactly this form names; null for anything else."""
    shape = "^" + pattern.replace("dd", r"\d{2}").replace("MM", r"\d{2}").replace("yyyy", r"\d{4}").replace("HH", r"\d{2}").replace("mm", r"\d{2}") + "$"
    return F.try_to_timestamp(F.when(text.rlike(shape) & (F.length(text) == len(pattern)), text), F.lit(pattern))


def updated_as_at(text: Column) -> Column:
    """The day after the words "updated as at" in a text; null where there is none, or no real one."""
    return F.to_date(stamp_of(F.nullif(F.regexp_extract(text, r"(?i)updated\s+as\s+at\s+(\d{2}/\d{2}/\d{4})", 1), F.lit("")), "dd/MM/yyyy"))


def halves(first: datetime.date, last: datetime.date, too_many: Callable[[datetime.date, datetime.date], bool]) -> list[tuple[datetime.date, datetime.date]]:
    """Windows of days that cover first..last, halved until none is too full for its source.

    A single day that still is too full cannot be halved: that is an error.
    """
    out, open_ = [], [(first, last)]
    while open_:
        a, b = open_.pop()
        if a > b:
            continue
        if not too_many(a, b):
            out.append((a, b))
        elif a == b:
            raise ValueError(f"{a} alone is too full")
        else:
            middle = a + (b - a) // 2
            open_ += [(middle + datetime.timedelta(1), b), (a, middle)]
    return out
