"""What the plans must keep: pruning, pushdown, few exchanges, bounded broadcasts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import tables as t
from tagloom.operators import clean, counts, forecasts as fc, panel, ranking as rk
from tagloom.operators.corpus import tweet_tokens
from tagloom.session import staged


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_counts_shuffle_texts_once_and_counts_once(spark, sf):
    plan = plan_of(t.daily(spark, sf))
    assert plan.count("Exchange") == 2
    assert plan.count("partial_count") == 1 and plan.count("partial_min") == 1


def test_both_tag_types_from_one_scan(spark, sf):
    plan = plan_of(t.lazy_counts(spark, sf))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2


def test_text_filter_and_columns_reach_the_scan(spark, sf):
    stored = staged(t.tweets(spark, sf).withColumn("unused", F.lit(1)), "tweets")
    plan = plan_of(clean.cleaned_tweets(stored))
    assert "PushedFilters: [IsNotNull(text)]" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"created_at", "text"}


def test_date_range_reaches_the_scan(spark, sf):
    stored = staged(t.lazy_counts(spark, sf), "counts")
    plan = plan_of(clean.between_dates(stored, "2024-01-05", "2024-01-06"))
    assert "GreaterThanOrEqual(date,2024-01-05)" in plan and "LessThanOrEqual(date,2024-01-06)" in plan


def test_the_count_table_is_filtered_without_a_shuffle(spark, sf):
    rows = t.counts(spark, sf)
    plan = plan_of(panel.counts_of(rows, t.selected(rows), t.SETTINGS.selected_rows))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    without = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in without


def test_tweets_are_parsed_once_and_only_deep_ones_are_shuffled(spark, sf):
    plan = plan_of(tweet_tokens(t.json_tweets(spark, sf)))
    scanned = plan.split("Exchange")[0]
    assert scanned.count("from_json(StructField(entities,StructType(StructField(hashtags") == 2  # the text, and what it leaves over
    assert plan.count("Exchange") == 1  # of the pieces of deep tweets, by text


def test_top_k_keeps_k_rows_per_task(spark, sf):
    top = rk.top_k(counts.overall_counts(t.cleaned(spark, sf)), 10, [F.desc("count"), "tag"])
    assert "TakeOrderedAndProject" in plan_of(top)


def test_all_metric_levels_take_one_shuffle(spark, sf):
    stored = t.stored_predictions(spark, sf)
    plan = plan_of(fc.all_metrics(stored))
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
