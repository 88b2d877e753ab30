"""Calendar arithmetic: weeks are named by their nearest Sunday, months by the nearest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sunday_on_or_before(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_of(day: Column) -> Column:
    """The Sunday nearest to a date (Wednesday goes back, Thursday forward)."""
    return _sunday_on_or_before(F.date_add(day.cast("date"), 3))


def week_of_instant(ts: Column) -> Column:
    """The Sunday nearest to a timestamp: the turn is Wednesday noon, which itself goes forward."""
    return _sunday_on_or_before((ts + F.expr("INTERVAL 84 HOURS")).cast("date"))


def month_of(day: Column) -> Column:
    """The first of a month nearest to a date; a tie goes to the later month."""
    day = day.cast("date")
    first = F.trunc(day, "MM")
    following = F.add_months(first, 1)
    return F.when(F.datediff(day, first) < F.datediff(following, day), first).otherwise(following)


def week_from_number(year: Column, week: Column) -> Column:
    """Week named by the nearest Sunday of the Monday that opens week number ``week`` of ``year``.

    Weeks are counted from the first Monday of the year.
    """
    first_monday = F.next_day(F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 1), "MON")
    return F.date_add(first_monday, 7 * (week - 1) - 1)


def shift_weeks(day: Column, weeks: int) -> Column:
    return F.date_add(day, 7 * weeks)


def weeks_between(start: Column, end: Column) -> Column:
    return F.floor(F.datediff(end, start) / 7).cast("int")


def parse_month_day_year(text: Column, pattern: str = "MMM d, yyyy") -> Column:
    """Text date to DATE; text that does not fit gives NULL."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")
