"""The derived tables on Spark, built by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.derive import CREATED_AT, TWEET_JSON, TWEET_TEXT
from checks.sql import END, MIN_DAYS, START, TOP_N, TRAIN, VALIDATION
from tagloom.operators import forecasts as fc
from tagloom.operators.clean import between_dates, cleaned_tweets
from tagloom.operators.corpus import tweet_tokens
from tagloom.operators.counts import daily_counts, long_daily_counts
from tagloom.operators.diagnostics import evaluation_rows
from tagloom.operators.panel import build_panel, select_top_tags
from tagloom.plans.feature_table import PanelSettings, feature_table
from tagloom.session import staged
from tagloom.sources.tables import modeling_rows

SETTINGS = PanelSettings(START, END, TOP_N, MIN_DAYS, TRAIN, VALIDATION)
METRICS = ("MAE", "RMSE", "sMAPE")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles for the comparison of two engines; adding 0 removes negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def positioned(df: DataFrame) -> DataFrame:
    """The rows of a sorted frame with their ``position`` in it, from 0.

    Rows are numbered inside each partition; the window runs over one row per partition.
    """
    placed = staged(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto_part = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part"))
    before = sizes.select("_part", (upto_part - F.col("_n")).alias("_before"))
    position = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "_part").withColumn("position", position).select(*df.columns, "position")


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", f"{CREATED_AT} AS created_at", f"{TWEET_TEXT} AS text"
    )


def json_tweets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id", f"{TWEET_JSON} AS json")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tweet_tokens(json_tweets(spark, sf), keep=("event_id",))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned_tweets(tweets(spark, sf))


def daily(spark: SparkSession, sf: str, tags: str = "hashtags") -> DataFrame:
    return daily_counts(cleaned(spark, sf), tags)


def lazy_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Long daily counts of both tag types inside the date range."""
    return between_dates(long_daily_counts(cleaned(spark, sf)), START, END)


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return staged(lazy_counts(spark, sf), "counts")


def selected(long_counts: DataFrame) -> DataFrame:
    return select_top_tags(long_counts, TOP_N, MIN_DAYS)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    long_counts = counts(spark, sf)
    return build_panel(long_counts, selected(long_counts), SETTINGS.selected_rows)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return feature_table(counts(spark, sf), SETTINGS)


def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table as later steps read it: from storage."""
    return staged(features(spark, sf), "features")


def modeling(spark: SparkSession, sf: str) -> DataFrame:
    return modeling_rows(features(spark, sf))


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return fc.baseline_forecasts(modeling(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long predictions of the four baselines, as if they were models."""
    return fc.long_forecasts(baselines(spark, sf), label="model")


def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return staged(predictions(spark, sf), "predictions")


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows of one model over the scored splits."""
    rows = fc.scored(predictions(spark, sf)).where("model = 'baseline_rolling_mean_3'")
    return staged(evaluation_rows(rows), "evaluated")
