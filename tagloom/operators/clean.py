"""Cleaning: null filters, deduplication, date ranges, numeric coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dates import to_day, week_start
from tagloom.functions.text import extract_cashtags, extract_hashtags
from tagloom.operators.quality import observed
from tagloom.session import BROADCAST_ROWS, staged


def drop_null_text(tweets: DataFrame, column: str = "text") -> DataFrame:
    return tweets.where(F.col(column).isNotNull())


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, nulls last.

    An aggregate rather than a window: every task first reduces its own copies,
    so a text that fills a third of the table never meets in one task.
    ``order`` must decide between copies for the result to be deterministic.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    best = F.min_by(F.struct(*rest), rank).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*").select(*df.columns)


def dedupe_text(tweets: DataFrame, order: Sequence[str], column: str = "text") -> DataFrame:
    """One tweet per text, the first by ``order``.

    A digest of each text is counted first, so that only texts whose digest was seen
    twice move, and are compared whole; the others pass where they are.  The list of such
    digests is sent to all tasks if it is short, else all texts are dealt out.
    """
    digest = F.xxhash64(column)
    twice = tweets.select(digest.alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows, seen = observed(twice.select("_digest", F.lit(True).alias("_twice")), {"digests": F.count(F.lit(1))})
    twice = staged(rows, "repeated-digests")
    if seen.get["digests"] > BROADCAST_ROWS:
        return first_per_key(tweets, [column], order)
    marked = tweets.withColumn("_digest", digest).join(F.broadcast(twice), "_digest", "left")
    once = marked.where("_twice IS NULL").select(*tweets.columns)
    return once.unionByName(first_per_key(marked.where("_twice").select(*tweets.columns), [column], order))


def distinct_texts(tweets: DataFrame) -> DataFrame:
    """One row per non-null text with the earliest readable date.

    Only the date is carried along, so the aggregate stays a hash aggregate.
    """
    return (
        drop_null_text(tweets)
        .groupBy("text")
        .agg(F.min(to_day(F.col("created_at"))).alias("date"))
    )


def add_tags(tweets: DataFrame) -> DataFrame:
    """Hashtags, cashtags and the Monday week of each tweet."""
    return tweets.withColumns(
        {
            "hashtags": extract_hashtags(F.col("text")),
            "cashtags": extract_cashtags(F.col("text")),
            "week": week_start(F.col("date")),
        }
    )


def cleaned_tweets(tweets: DataFrame) -> DataFrame:
    """``date, text, hashtags, cashtags`` of the distinct texts."""
    return add_tags(distinct_texts(tweets)).select("date", "text", "hashtags", "cashtags")


def between_dates(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """Inclusive date range; rows without a date leave."""
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_empty(df: DataFrame, column: str) -> DataFrame:
    """Drop null and empty strings."""
    return df.where(F.coalesce(F.col(column), F.lit("")) != "")


def numeric_pairs(df: DataFrame, columns: Sequence[str] = ("actual", "prediction")) -> DataFrame:
    """Coerce the columns to double and drop rows where one is missing."""
    coerced = {c: F.col(c).try_cast("double") for c in columns}
    return df.withColumns(coerced).dropna(subset=list(columns))


def keep_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def group_threshold(df: DataFrame, condition: Column | str) -> DataFrame:
    """HAVING: keep the groups of an aggregated table that satisfy a condition."""
    return df.where(condition)
