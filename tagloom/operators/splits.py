"""Time-ordered train, validation and test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.panel import date_positions, date_spine
from tagloom.session import BROADCAST_ROWS, broadcast_if_bounded

SPLIT_ORDER = ("train", "validation", "test")


def split_name(position: Column, train_dates: int, validation_dates: int) -> Column:
    """Split of a zero-based date position."""
    return (
        F.when(position < train_dates, "train")
        .when(position < train_dates + validation_dates, "validation")
        .otherwise("test")
    )


def split_calendar(df: DataFrame, train_dates: int = 55, validation_dates: int = 11) -> DataFrame:
    """``date, date_position, split`` for the distinct dates of a table."""
    name = split_name(F.col("date_position"), train_dates, validation_dates)
    return date_positions(df).withColumn("split", name)


def add_splits(
    features: DataFrame,
    train_dates: int = 55,
    validation_dates: int = 11,
    dates_of: DataFrame | None = None,
) -> DataFrame:
    """Label rows by the calendar of their own table, or of ``dates_of``.

    A date's position decides its split, so the first validation date and the
    first test date say it all: they come from a one-row subquery and the table
    is labelled in place, without a join.  Rows without a date get no split.
    """
    dates = date_spine(features if dates_of is None else dates_of)
    first = dates.select(
        F.struct(
            F.get("dates", F.lit(train_dates)).alias("validation"),
            F.get("dates", F.lit(train_dates + validation_dates)).alias("test"),
        ).alias("first")
    ).scalar()
    date, validation, test = F.col("date"), F.col("_first.validation"), F.col("_first.test")
    before = lambda bound: bound.isNull() | (date < bound)  # noqa: E731 - no such date: all earlier
    label = F.when(before(validation), "train").when(before(test), "validation").otherwise("test")
    labelled = features.withColumn("_first", first).withColumn("split", F.when(date.isNotNull(), label))
    return labelled.drop("_first")


def join_splits(features: DataFrame, calendar: DataFrame) -> DataFrame:
    """Label rows by a given calendar of one row per date.

    It is sent to all tasks only if it is short, as a table of dates should be.
    """
    dates = calendar.select("date", "split")
    near = broadcast_if_bounded(dates, dates.limit(BROADCAST_ROWS + 1).count())
    return features.join(near, "date", "left")
