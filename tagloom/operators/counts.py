"""Counting tags, words and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dates import week_start
from tagloom.functions.text import space_tokens, whitespace_tokens


def exploded_tags(tweets: DataFrame, tags: str, *keep: str) -> DataFrame:
    """One row per tag occurrence; tweets without tags vanish, repeats count."""
    return tweets.select(*keep, F.explode(tags).alias("tag"))


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def daily_counts(tweets: DataFrame, tags: str = "hashtags") -> DataFrame:
    return _count(exploded_tags(tweets, tags, "date"), "date", "tag")


def long_daily_counts(tweets: DataFrame) -> DataFrame:
    """Daily counts of both tag types from one pass: ``date, tag, tag_type, count``."""
    typed = F.array(
        F.struct(F.lit("hashtag").alias("tag_type"), F.col("hashtags").alias("tags")),
        F.struct(F.lit("cashtag").alias("tag_type"), F.col("cashtags").alias("tags")),
    )
    both = tweets.select("date", F.inline(typed))
    return _count(exploded_tags(both, "tags", "date", "tag_type"), "date", "tag", "tag_type")


def weekly_counts(tweets: DataFrame, tags: str = "hashtags") -> DataFrame:
    with_week = tweets.withColumn("week", week_start(F.col("date")))
    return _count(exploded_tags(with_week, tags, "week"), "week", "tag")


def overall_counts(tweets: DataFrame, tags: str = "hashtags") -> DataFrame:
    return _count(exploded_tags(tweets, tags), "tag")


def weekly_from_daily(daily: DataFrame) -> DataFrame:
    """Weekly counts as sums of daily ones: the tweets need not be read again."""
    return (
        daily.withColumn("week", week_start(F.col("date")))
        .groupBy("week", "tag")
        .agg(F.sum("count").alias("count"))
    )


def word_count(lines: DataFrame, column: str = "value", tokens: Column | None = None) -> DataFrame:
    """Words of the lines and their counts; splits on single spaces unless told otherwise."""
    words = space_tokens(F.col(column)) if tokens is None else tokens
    return _count(lines.select(F.explode(words).alias("word")), "word")


def whitespace_word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    return word_count(lines, column, whitespace_tokens(F.col(column)))


def totals_by(df: DataFrame, *keys: str, value: str = "count", name: str | None = None) -> DataFrame:
    """Sum of a measure per key."""
    return df.groupBy(*keys).agg(F.sum(value).alias(name or value))


def tag_summary(counts: DataFrame, unique_days: bool = False) -> DataFrame:
    """Total count and number of observed days per tag.

    ``unique_days`` promises one row per tag and date, as counting gives: days
    are then counted in each task, and only one row per tag is shuffled.
    """
    days = F.count("date") if unique_days else F.count_distinct("date")
    return counts.groupBy("tag_type", "tag").agg(
        F.sum("count").alias("total_count"), days.alias("observed_days")
    )


def distinct_tags_by_type(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tag_type").agg(F.count_distinct("tag").alias("tags"))


def value_counts(df: DataFrame, column: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows per value; labels listed in ``order`` first and in that order, then the rest."""
    labels = F.array(*[F.lit(label) for label in order]) if order else None
    counted = _count(df, column)
    if labels is None:
        return counted.orderBy(column)
    place = F.array_position(labels, F.col(column))
    return counted.orderBy(place == 0, place, column)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def date_range(df: DataFrame, column: str = "date") -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))


def positive_share(df: DataFrame, column: str) -> DataFrame:
    """Share of all rows with a value above 0; a missing value counts as not above."""
    above = F.coalesce(F.col(column) > 0, F.lit(False))
    return df.agg(F.avg(above.cast("int")).alias("coverage"))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value, ties to the smallest.

    Counting first keeps memory flat however many distinct values there are.
    """
    counted = _count(df.where(F.col(column).isNotNull()), column)
    return counted.orderBy(F.desc("count"), column).limit(1)
