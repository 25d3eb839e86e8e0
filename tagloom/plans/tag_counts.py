"""Tweets to cleaned tweets and to daily, weekly and overall tag counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.clean import cleaned_tweets
from tagloom.operators.counts import long_daily_counts, totals_by, weekly_from_daily
from tagloom.operators.quality import observed
from tagloom.operators.ranking import by_date_and_count, top_k
from tagloom.session import staged
from tagloom.sinks.writers import write_by_date, write_table
from tagloom.sources.tweets import CORRUPT_COLUMN, read_tweets_csv


@dataclass(frozen=True)
class TagCounts:
    """All counts, derived from one long table of daily counts.

    The daily counts are far smaller than the tweets; weeks and totals are sums
    of them, so the tweets are read once.
    """

    daily_counts: DataFrame
    rows: int | None = None
    corrupt: int | None = None

    def of_type(self, tag_type: str) -> DataFrame:
        return self.daily_counts.where(F.col("tag_type") == tag_type).select("date", "tag", "count")

    def daily(self, tag_type: str = "hashtag") -> DataFrame:
        return by_date_and_count(self.of_type(tag_type))

    def weekly(self, tag_type: str = "hashtag") -> DataFrame:
        return by_date_and_count(weekly_from_daily(self.of_type(tag_type)), "week")

    def top(self, k: int = 10, tag_type: str = "hashtag") -> DataFrame:
        return top_k(totals_by(self.of_type(tag_type), "tag"), k, [F.desc("count"), "tag"])


def tag_counts(cleaned: DataFrame) -> TagCounts:
    """Count the tags of cleaned tweets once and keep the result."""
    return TagCounts(staged(long_daily_counts(cleaned), "daily-counts"))


def run(spark: SparkSession, csv_path: str, output: str) -> TagCounts:
    """Read and clean once, write the cleaned table, and count from the written table.

    The rows read and those that did not fit the header are counted by the pass that writes.
    """
    cleaned = f"{output}/cleaned_tweets.parquet"
    metrics = {"rows": F.count(F.lit(1)), "corrupt": F.count(CORRUPT_COLUMN)}
    tweets, seen = observed(read_tweets_csv(spark, csv_path), metrics)
    write_by_date(cleaned_tweets(tweets), cleaned)
    counts = replace(tag_counts(spark.read.parquet(cleaned)), **seen.get)
    write_table(counts.daily("hashtag"), f"{output}/daily_hashtag_counts.parquet")
    write_table(counts.daily("cashtag"), f"{output}/daily_cashtag_counts.parquet")
    write_table(counts.weekly("hashtag"), f"{output}/weekly_hashtag_counts.parquet")
    return counts
