"""Relative date phrases as half-open ranges, and the overlapping and disjoint date buckets."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = {"this": 0, "last": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
_UNITS = ("day", "week", "month", "year")


def _start(unit: str, now: datetime) -> datetime:
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        return day - timedelta(days=day.weekday())
    return day.replace(day=1) if unit == "month" else day.replace(month=1, day=1) if unit == "year" else day


def _back(start: datetime, unit: str, n: int) -> datetime:
    if unit in ("day", "week"):
        return start - timedelta(days=n * (7 if unit == "week" else 1))
    months = start.year * 12 + start.month - 1 - n * (12 if unit == "year" else 1)
    return start.replace(year=months // 12, month=months % 12 + 1)


def date_range(phrase: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """[start, end) of a phrase: today, yesterday, this/last/two/... day(s), week(s), month(s), year(s), plus, ago; or a
    Unix time, from then on. `plus` means that long ago or longer. ValueError for anything else.

    Calendar semantics: weeks begin on Monday, months on the first.
    """
    text = phrase.strip().lower()
    if text.isdigit():
        return datetime.fromtimestamp(int(text), tz=None if now.tzinfo is None else now.tzinfo), None
    words = [w for w in re.split(r"\s+", text) if w and w != "ago"]
    plus = bool(words) and words[-1] == "plus"
    words = words[:-1] if plus else words
    if len(words) == 1 and words[0] in ("today", "yesterday"):
        unit, n = "day", int(words[0] == "yesterday")
    elif len(words) == 2 and words[1].rstrip("s") in _UNITS and (words[0] in _NUMBERS or words[0].isdigit()):
        unit, n = words[1].rstrip("s"), _NUMBERS[words[0]] if words[0] in _NUMBERS else int(words[0])
    else:
        raise ValueError(f"not a date phrase: {phrase!r}")
    start = _back(_start(unit, now), unit, n)
    return (None, _back(start, unit, -1)) if plus else (start, _back(start, unit, -1))


def buckets(ts: Column, now: Column) -> dict[str, Column]:
    """Seven conditions that overlap: a day is also in its week, month and year."""
    day = F.date_trunc("day", now)
    year = F.date_trunc("year", now)
    return {
        "today": ts >= day,
        "yesterday": (ts >= day - F.expr("interval 1 day")) & (ts < day),
        "this_week": ts >= F.date_trunc("week", now),
        "this_month": ts >= F.date_trunc("month", now),
        "this_year": ts >= year,
        "last_year": (ts >= F.add_months(year, -12)) & (ts < year),
        "two_years_plus": ts < F.add_months(year, -12),
    }


def view_range(ts: Column, now: Column) -> Column:
    """The one disjoint range of a time: today, yesterday, last 7 days, last 31 days, this year, last year, N years ago."""
    day = F.date_trunc("day", now)
    years = F.year(now) - F.year(ts)
    return F.when(ts >= day, "today").when(ts >= day - F.expr("interval 1 day"), "yesterday").when(ts >= day - F.expr("interval 7 days"), "last 7 days").when(ts >= day - F.expr("interval 31 days"), "last 31 days").when(years == 0, "this year").when(years == 1, "last year").otherwise(F.concat(years.cast("string"), F.lit(" years ago")))
