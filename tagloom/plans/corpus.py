"""JSON tweets to token lists and sorted word counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.corpus import token_totals, tweet_tokens
from tagloom.operators.counts import word_count
from tagloom.operators.ranking import by_count
from tagloom.session import staged
from tagloom.sinks.writers import write_pairs, write_token_lists
from tagloom.sources.tweets import is_unreadable, read_tokens, read_tweets_json


@dataclass(frozen=True)
class Corpus:
    """Token totals, sorted word counts, and how many lines were read and could not be."""

    totals: DataFrame
    counts: DataFrame
    lines: int
    unreadable: int


def run(spark: SparkSession, tweets_path: str, output: str) -> Corpus:
    """Write the three token lists and the sorted counts of the combined one.

    Lines are counted, and checked, by one more pass over the text that is not parsed into
    tokens: texts go two ways there, so neither sees them all.
    """
    tweets = read_tweets_json(spark, tweets_path)
    lines, unreadable = tweets.agg(F.count(F.lit(1)), F.count_if(is_unreadable("json"))).first()
    tokens = staged(tweet_tokens(tweets), "tokens")
    paths = write_token_lists(tokens, output)
    counts = word_count(read_tokens(spark, paths["combined"]))
    write_pairs(counts, f"{output}/word_counts")
    return Corpus(token_totals(tokens), by_count(counts, "word"), lines, unreadable)
