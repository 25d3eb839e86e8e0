"""The jobs in order, from raw tweets to error tables."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tagloom.__main__ import main
from tagloom.operators import models as ml
from tagloom.plans import feature_table, forecasting, reports
from tagloom.session import sizing, staged
from tests.conftest import rows


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    rng = random.Random(1)
    lines = ["created_at,text"]
    for i in range(40):
        day = dt.date(2020, 4, 9) + dt.timedelta(days=i)
        for n in range(rng.randint(12, 20)):
            tag = rng.choice(["#Up", "#Down", "#Flat"])
            lines.append(f"{day}T0{n % 10}:00:00Z,{tag} {rng.choice(['$aa', '$bb', '$cc'])} number {i * 100 + n}")
    (folder / "tweets.csv").write_text("\n".join(lines + [lines[-1]]) + "\n")
    return folder


def test_jobs(spark, work, monkeypatch):
    monkeypatch.setattr("tagloom.plans.forecasting.MODEL_CONFIGS", ml.MODEL_CONFIGS[:2])
    monkeypatch.setattr(forecasting.run, "__defaults__", ("count_only", ml.MODEL_CONFIGS[:2], ""))
    job = lambda *a: main([str(x) for x in a], spark)
    panel = ["--top-n", 3, "--min-days", 20, "--train-dates", 25, "--validation-dates", 7]
    job("counts", work / "tweets.csv", work / "counts")
    job("activity", work / "counts", work / "activity")
    job("features", work / "counts", work / "features", *panel)
    job("overview", work / "features", work / "overview")
    job("forecast", work / "features", work / "forecast")
    job("errors", work / "forecast", work / "errors")
    job("forecast", work / "features", work / "forecast", "--run-label", "again")

    read = lambda *p: spark.read.parquet(str(work.joinpath(*p)))
    features = read("features")
    assert features.count() == 40 * 6 and features.where("modeling_ready").count() == 32 * 6
    raw = (work / "tweets.csv").read_text().splitlines()[1:-1]
    assert read("activity", "top_hashtags").agg(F.sum("count")).first()[0] == len(raw)
    assert read("activity", "top_cashtag_shares").agg(F.sum("share")).first()[0] == pytest.approx(100)
    assert set(read("activity", "hashtag_trend").columns) == {"date", "#up", "#down", "#flat"}
    assert read("activity", "weekly_hashtags").count() == 3
    assert rows(read("overview", "tags_by_type")) == [("cashtag", 3), ("hashtag", 3)]
    assert read("overview", "count_histogram").agg(F.sum("rows")).first()[0] == 240
    assert read("overview", "target_histogram").agg(F.sum("rows")).first()[0] == 234
    assert read("errors", "validation_vs_test").count() == 4 + 2
    assert read("errors", "accuracy_vs_time").count() == 2
    assert read("errors", "worst_misses").count() == 16
    assert read("errors", "residual_histogram").agg(F.sum("rows")).first()[0] == 14 * 6
    assert read("errors", "heat_map").count() == 6
    assert rows(read("errors", "example_series").select("model").distinct()) == [
        ("baseline_last_value",), ("linear_regression_pooled",), ("ridge_regression_pooled",)
    ]
    compared = read("forecast", "run_comparison")
    assert rows(compared.groupBy("run_label").count()) == [("again", 6), ("count_only", 6)]
    with pytest.raises(ValueError, match="expected 41 observed dates, found 40"):
        job("features", work / "counts", work / "more", *panel, "--dates", 41)
    with pytest.raises(ValueError, match="selected tags"):
        job("features", work / "counts", work / "more", "--top-n", 4, "--min-days", 20)


def test_corpus_job(spark, work):
    (work / "tweets.json").write_text(json.dumps({"entities": {"hashtags": [{"text": "A"}]}}) + "\n")
    main(["corpus", str(work / "tweets.json"), str(work / "corpus")], spark)
    assert rows(spark.read.text(str(work / "corpus" / "combined"))) == [("#a",)]


def test_comparison_of_two_models(spark):
    schema = "split string, tag_type string, tag string, model string, rows long, MAE double, RMSE double, sMAPE double"
    a = spark.createDataFrame([("test", "hashtag", f"#{i}", "a", 10, 1.0, 1.0, float(i)) for i in range(20)], schema)
    b = a.withColumn("model", F.lit("b")).withColumn("sMAPE", F.col("sMAPE") * 2 - 10)
    tables = reports.tag_tables(a, b, ("a", "b"))
    assert tables["tag_changes"].count() == 20 and tables["hardest_tags_a"].first()["tag"] == "#5"
    types = reports.type_tables(a.unionByName(b).where("tag = '#7'"), ["a", "b"])["type_smape"]
    assert rows(types) == [("hashtag", 7.0, 4.0)]


def test_systems_summary_of_a_learned_and_a_timed_run(spark):
    first = spark.read.json(spark.sparkContext.parallelize([json.dumps({"features": "f", "model_training_seconds": {"a": 0.5, "b": 1.5}})]))
    second = spark.read.json(spark.sparkContext.parallelize([json.dumps({"features": "f", "device_used": "cuda", "gpu_requested": True, "model_params": {"epochs": 100, "batch_size": 64}, "total_training_seconds": 197.9})]))
    got = reports.systems_summary({"pooled": first, "timed": second})
    assert rows(got.select("run", "device_used", "epochs", "total_training_seconds")) == [("pooled", None, None, 2.0), ("timed", "cuda", 100, 197.9)]


def test_sentiment_tables(spark):
    table = spark.createDataFrame([(1, 0.5, 2), (2, 0.1, 0)], "id int, mean_sentiment double, sentiment_tweet_count int")
    tables = reports.sentiment_tables(table)
    assert rows(tables["describe"], "measure", "count") == [("mean_sentiment", 2), ("sentiment_tweet_count", 2)]
    assert tables["coverage"].first()[0] == 0.5
    assert list(reports.sentiment_tables(table.select("id"))) == ["shape"]


def test_default_settings_select_thirty_tags():
    assert feature_table.PanelSettings().selected_rows == 30


def test_sizing():
    conf = sizing(100 * 10**12, 4000)
    partitions = int(conf["spark.sql.shuffle.partitions"])
    assert partitions % 4000 == 0 and 100 * 10**12 / partitions <= 192 * 1024**2
    assert sizing(10, 8)["spark.sql.shuffle.partitions"] == "8"


def test_sizes_are_counted_by_the_write(spark):
    settings = feature_table.PanelSettings(start="2020-04-01", top_n=1, train_dates=10, validation_dates=3)
    days = spark.range(16).selectExpr("date_add(DATE'2020-04-09', cast(id as int)) AS date", "id")
    split = F.when(F.col("id") < 10, "train").when(F.col("id") < 13, "validation").otherwise("test")
    ready = (F.col("id") >= 7) & (F.col("id") < 15)
    table = days.crossJoin(spark.sql("SELECT explode(array('hashtag', 'cashtag')) AS tag_type")).select("date", split.alias("split"), ready.alias("modeling_ready"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    _, counted = feature_table.staged_features(table, settings)
    plain_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    staged(table, "features")
    assert plain_jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before - plain_jobs
    assert counted == {"rows": 32, "rows_train": 6, "rows_validation": 6, "rows_test": 4, "dates": 16, "undated": 0}
    assert feature_table.expected_split_rows(settings, 16) == {"train": 6, "validation": 6, "test": 4}
    assert feature_table.expected_split_rows(feature_table.PanelSettings(), 77) == {"train": 1440, "validation": 330, "test": 300}
