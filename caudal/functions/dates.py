"""Month and working-day arithmetic as plain column expressions (no calendar table, no join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day numbers (days since 1970-01-01) of the first Sunday, and days in a week.
FIRST_SUNDAY = 3
WEEK = 7


def month_number(day: Column) -> Column:
    """Months since year 0, so that month arithmetic is integer arithmetic."""
    return F.year(day) * 12 + F.month(day) - 1


def label_number(label: Column) -> Column:
    """`YYYY-MM` to a month number."""
    return F.substring(label, 1, 4).cast("int") * 12 + F.substring(label, 6, 2).cast("int") - 1


def month_start(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))


def month_end(number: Column) -> Column:
    return F.last_day(month_start(number))


def month_label(number: Column) -> Column:
    return F.date_format(month_start(number), "yyyy-MM")


def shift_label(label: Column, months: int) -> Column:
    """The `YYYY-MM` label some months later (or earlier)."""
    return month_label(label_number(label) + F.lit(months))


def is_sunday(day: Column) -> Column:
    return F.weekday(day) == 6


def working_days(start: Column, end: Column) -> Column:
    """Days from `start` to `end`, both included, that are not Sundays; 0 when the range is empty."""
    first, last = F.unix_date(start), F.unix_date(end)
    sundays = F.floor((last - FIRST_SUNDAY) / WEEK) - F.floor((first - 1 - FIRST_SUNDAY) / WEEK)
    return F.when(last < first, F.lit(0)).otherwise((last - first + 1 - sundays).cast("int"))


def add_months_clipped(day: Column, months: int) -> Column:
    """Whole months later, clipped to the end of a shorter month."""
    return F.add_months(day, months)
