"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last whole day of a 64-bit nanosecond timestamp.
FIRST_EPOCH_DAY = -106751
LAST_EPOCH_DAY = 106751


def to_day(value: Column) -> Column:
    """Timestamp or string to date; unreadable input gives null, not an error."""
    return value.try_cast("date")


def week_start(date: Column) -> Column:
    """Monday of the week, as a timestamp."""
    return F.date_trunc("week", date)


def day_from_epoch(days: Column) -> Column:
    """Days since 1970-01-01 to a date; days outside the valid range give null."""
    whole = F.floor(days)
    inside = whole.between(FIRST_EPOCH_DAY, LAST_EPOCH_DAY)
    return F.date_from_unix_date(F.when(inside, whole).cast("int"))


def monday_zero(date: Column) -> Column:
    """Day of the week with Monday as 0."""
    return F.weekday(date)


def iso_day(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")
