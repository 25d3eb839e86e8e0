from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagloom.functions import arithmetic as ar
from tagloom.operators import clean, counts, ranking as rk
from tagloom.plans import tag_counts
from tagloom.session import staged
from tagloom.sources.tweets import read_tweets_csv
from tests.conftest import rows


def test_dedupe_is_deterministic_and_nulls_last(spark):
    data = [("t", None, 1), ("t", "2020-01-02", 3), ("t", "2020-01-02", 2), ("u", None, 5), ("u", None, 4)]
    df = spark.createDataFrame(data, "text string, created_at string, id int")
    assert rows(clean.dedupe_text(df, ["created_at", "id"])) == [("t", "2020-01-02", 2), ("u", None, 4)]


def test_distinct_texts(spark):
    data = [("t", "garbage"), ("t", "2020-01-03"), ("t", "2020-01-02T10:00:00Z"), (None, "2020-01-01"), ("u", "garbage")]
    df = spark.createDataFrame(data, "text string, created_at string")
    assert rows(clean.distinct_texts(df)) == [("t", dt.date(2020, 1, 2)), ("u", None)]


def test_a_hot_text_is_reduced_before_the_shuffle(spark):
    """A third of the rows share a text: every task must send one row of it, not all."""
    df = spark.range(0, 30_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"),
        F.lit("2020-01-01").alias("created_at"),
        "id",
    )
    for result in (clean.distinct_texts(df), clean.dedupe_text(df, ["id"])):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.index("partial_min") > plan.index("Exchange hashpartitioning(text")
        assert "Window" not in plan
        assert result.count() == 20_001


def test_counts_and_null_dates(spark):
    data = [("#a #a $x", dt.date(2020, 1, 1)), ("#a", None), ("plain", dt.date(2020, 1, 1))]
    tweets = clean.add_tags(spark.createDataFrame(data, "text string, date date"))
    assert rows(counts.daily_counts(tweets)) == [(None, "#a", 1), (dt.date(2020, 1, 1), "#a", 2)]
    assert rows(counts.overall_counts(tweets)) == [("#a", 3)]
    assert rows(counts.long_daily_counts(tweets)) == rows(
        counts.daily_counts(tweets).withColumn("tag_type", F.lit("hashtag")).select("date", "tag", "tag_type", "count")
        .union(counts.daily_counts(tweets, "cashtags").withColumn("tag_type", F.lit("cashtag")).select("date", "tag", "tag_type", "count"))
    )
    assert rows(clean.between_dates(counts.daily_counts(tweets), "2020-01-01", "2020-01-01")) == [(dt.date(2020, 1, 1), "#a", 2)]


def test_weeks_start_on_monday(spark):
    tweets = clean.add_tags(spark.createDataFrame([("#a", dt.date(2020, 1, 5)), ("#a", dt.date(2020, 1, 6))], "text string, date date"))
    assert rows(counts.weekly_counts(tweets)) == [(dt.datetime(2019, 12, 30), "#a", 1), (dt.datetime(2020, 1, 6), "#a", 1)]
    assert rows(counts.weekly_from_daily(counts.daily_counts(tweets))) == rows(counts.weekly_counts(tweets))


def test_word_counts(spark):
    lines = spark.createDataFrame([("a  b ",), ("",), ("   ",), (" a",)], "value string")
    assert rows(counts.word_count(lines)) == [("", 3), ("a", 2), ("b", 1)]
    assert rows(counts.whitespace_word_count(lines)) == [("a", 2), ("b", 1)]


def test_value_counts_order_and_coverage(spark):
    df = spark.createDataFrame([("test", 1.0), ("train", 0.0), ("zzz", None), ("train", 2.0)], "split string, x double")
    assert [r["split"] for r in counts.value_counts(df, "split", ("train", "validation", "test")).collect()] == ["train", "test", "zzz"]
    assert counts.positive_share(df, "x").first()["coverage"] == 0.5
    assert tuple(counts.most_frequent(df, "split").first()) == ("train", 2)


def test_ranking(spark):
    df = spark.createDataFrame([("x", "b", 2), ("x", "a", 2), ("x", "c", 1), ("y", "d", 9)], "g string, tag string, count int")
    order = [F.desc("count"), "tag"]
    assert [r["tag"] for r in rk.top_k(df, 2, order).collect()] == ["d", "a"]
    assert rows(rk.top_per_group(df, 1, ["g"], order), "g", "tag") == [("x", "a"), ("y", "d")]
    assert rows(rk.top_per_group(df, 2000, ["g"], order)) == rows(df)
    spark.conf.set(rk.GROUP_LIMIT_CONF, "1")
    try:
        assert rows(rk.top_per_group(df, 2, ["g"], order), "tag") == [("a",), ("b",), ("d",)]
    finally:
        spark.conf.unset(rk.GROUP_LIMIT_CONF)
    assert [r["tag"] for r in rk.top_k_reversed(df, 3, "count", ["tag"]).collect()] == ["b", "a", "d"]
    both = rk.extremes(df, 1, "count", ["tag"], ("over", "under"))
    assert rows(both, "side", "tag") == [("over", "d"), ("under", "c")]
    assert rows(rk.share_of_total(df.where("g = 'x'"), "count"), "tag", "share") == [("a", 40.0), ("b", 40.0), ("c", 20.0)]


def test_ranked_groups_are_limited_in_each_task(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS tag", "id AS count")
    plan = rk.top_per_group(df, 15, ["g"], [F.desc("count"), "tag"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (None, None), (-4.0, 2.0)], "d double, b double")
    d, b = F.col("d"), F.col("b")
    assert [r[0] for r in df.select(ar.change_ratio(d, b)).collect()] == [0.0, 1.5, None, -2.0]
    assert [r[0] for r in df.select(ar.standard_score(d, b)).collect()] == [None, 1.5, None, -2.0]
    assert [r[0] for r in df.select(ar.at_least(d, 0.0)).collect()] == [1.0, 3.0, None, 0.0]
    assert [r[0] for r in df.select(ar.at_most(d, 2.0)).collect()] == [1.0, 2.0, None, -4.0]
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in odd.select(ar.finite_or_null(F.col("x"))).collect()] == [None, None, None, 1.0, None]


def test_numeric_pairs(spark):
    df = spark.createDataFrame([("1", "2"), ("x", "2"), (None, "1"), ("3.5", "0")], "actual string, prediction string")
    assert rows(clean.numeric_pairs(df)) == [(1.0, 2.0), (3.5, 0.0)]


def test_csv_to_counts(spark, tmp_path):
    body = (
        "id,created_at,text\n"
        '1,2020-04-09T23:59:51Z,"two lines\nof #Tag and $aa"\n'
        '2,garbage,"says ""#Quote"""\n'
        "3,2020-04-10 00:00:01+00:00,#tag\n"
        "4,2020-04-11,\n"
    )
    path = tmp_path / "tweets.csv"
    path.write_text(body)
    tweets = read_tweets_csv(spark, str(path))
    assert tweets.columns == ["created_at", "text", "_corrupt"]
    assert tweets.count() == 4
    result = tag_counts.tag_counts(clean.cleaned_tweets(tweets))
    first, second = dt.date(2020, 4, 9), dt.date(2020, 4, 10)
    assert [tuple(r) for r in result.daily().collect()] == [(None, "#quote", 1), (first, "#tag", 1), (second, "#tag", 1)]
    assert [tuple(r) for r in result.top(1).collect()] == [("#tag", 2)]
    inferred = read_tweets_csv(spark, str(path), schema=None)
    assert inferred.count() == 4
    split = read_tweets_csv(spark, str(path), schema=None, multi_line=False)
    assert split.count() > 4


def test_csv_columns_are_found_by_name_and_bad_rows_kept(spark, tmp_path):
    from pyspark.sql import types as T

    path = tmp_path / "tweets.csv"
    path.write_text("text,likes,other,created_at\n#a,3,x,2020-04-09\n#b,many,y,2020-04-10\n")
    schema = T.StructType([T.StructField("created_at", T.StringType()), T.StructField("text", T.StringType()), T.StructField("likes", T.IntegerType())])
    got = rows(read_tweets_csv(spark, str(path), schema))
    assert got == [("2020-04-09", "#a", 3, None), ("2020-04-10", "#b", None, "#b,many,y,2020-04-10")]
    with pytest.raises(ValueError, match="created_at"):
        path.write_text("text\n#a\n")
        read_tweets_csv(spark, str(path))


def test_tag_count_job_writes_all_tables(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text("created_at,text\n2020-04-09,#a $b\n2020-04-09,#a $b\n2020-04-10,#a #c\nbad,#d\n")
    tag_counts.run(spark, str(path), str(tmp_path / "out"))
    daily = spark.read.parquet(str(tmp_path / "out" / "daily_hashtag_counts.parquet"))
    day = dt.date
    assert rows(daily) == [(None, "#d", 1), (day(2020, 4, 10), "#a", 1), (day(2020, 4, 10), "#c", 1), (day(2020, 4, 9), "#a", 1)]
    cash = spark.read.parquet(str(tmp_path / "out" / "daily_cashtag_counts.parquet"))
    assert rows(cash) == [(day(2020, 4, 9), "$B", 1)]
    weekly = spark.read.parquet(str(tmp_path / "out" / "weekly_hashtag_counts.parquet"))
    assert rows(weekly, "tag", "count") == [("#a", 2), ("#c", 1), ("#d", 1)]


def test_csv_files_with_different_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("created_at,text\n2020-01-01,#a\n")
    (tmp_path / "b.csv").write_text("text,created_at\n#b,2020-01-02\n")
    for multi_line in (True, False):
        with pytest.raises(Exception, match="(?i)header"):
            read_tweets_csv(spark, str(tmp_path), multi_line=multi_line).collect()


def test_only_repeated_texts_move(spark, monkeypatch):
    texts = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.concat(F.lit("t"), F.col("id") % 200))
    df = staged(spark.range(600).select("id", texts.alias("text"), (-F.col("id")).alias("n")), "texts")
    want = {}
    for r in df.collect():
        want[r.text] = max(want.get(r.text, -1), r.id)
    found = clean.dedupe_text(df, ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(text") == 1 and "_twice" in plan.split("hashpartitioning(text")[0]
    assert found.columns == df.columns and {r.text: r.id for r in found.collect()} == want and found.count() == len(want)
    monkeypatch.setattr(clean, "BROADCAST_ROWS", 3)
    assert {r.text: r.id for r in clean.dedupe_text(df, ["n"]).collect()} == want
