from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tagloom.functions.metrics import error_metrics
from tagloom.operators import diagnostics as dg, forecasts as fc, reshape
from tests.conftest import rows

DAY = dt.date(2020, 7, 1)
SCHEMA = "date date, tag string, tag_type string, target_next_count double, split string, model string, prediction double"


def predictions(spark):
    data = []
    for m, shift in (("a", 1.0), ("b", -2.0)):
        for split in ("train", "validation", "test"):
            for i, (tag, tag_type, y) in enumerate([("#x", "hashtag", 5.0), ("#y", "hashtag", 0.0), ("$Z", "cashtag", 10.0)]):
                data.append((DAY + dt.timedelta(days=i), tag, tag_type, y, split, m, max(y + shift * (i + 1), 0.0)))
    return spark.createDataFrame(data, SCHEMA)


def test_metric_fixture(spark):
    df = spark.createDataFrame([(10.0, 8.0), (0.0, 0.0), (0.0, 5.0), (20.0, 30.0)], "a double, p double")
    row = df.agg(*error_metrics("a", "p")).first()
    assert row["rows"] == 4 and row["MAE"] == 4.25
    assert math.isclose(row["RMSE"], 5.678908, abs_tol=1e-6) and math.isclose(row["sMAPE"], 65.555556, abs_tol=1e-6)


def test_metric_tables_combine(spark):
    """Overall errors are row-weighted means of the per-type ones; RMSE combines through squares."""
    df = predictions(spark)
    overall = {(r["split"], r["model"]): r for r in fc.overall_metrics(df).collect()}
    by_type = fc.metrics_by_type(df).collect()
    assert set(overall) == {(s, m) for s in ("validation", "test") for m in ("a", "b")}
    for key, whole in overall.items():
        parts = [r for r in by_type if (r["split"], r["model"]) == key]
        n = sum(r["rows"] for r in parts)
        assert n == whole["rows"]
        for metric in ("MAE", "sMAPE"):
            assert math.isclose(sum(r[metric] * r["rows"] for r in parts) / n, whole[metric])
        assert math.isclose(math.sqrt(sum(r["RMSE"] ** 2 * r["rows"] for r in parts) / n), whole["RMSE"])


def test_published_type_metrics_combine_to_the_published_overall(spark):
    parts = spark.createDataFrame([("cashtag", 150, 157.89333333333335), ("hashtag", 150, 106.50666666666666)], "t string, n int, mae double")
    assert parts.agg((F.sum(F.col("n") * F.col("mae")) / F.sum("n"))).first()[0] == pytest.approx(132.2)


def test_grouping_sets_equal_the_separate_tables(spark):
    df = predictions(spark)
    both = fc.all_metrics(df)
    assert rows(both.where("level = 'overall'").select(*fc.METRIC_COLUMNS)) == rows(fc.overall_metrics(df).select(*fc.METRIC_COLUMNS))
    columns = ["split", "tag_type", "model", "rows", "MAE", "RMSE", "sMAPE"]
    assert rows(both.where("level = 'by_type'").select(*columns)) == rows(fc.metrics_by_type(df).select(*columns))
    tag = ["tag_type", "tag", "model", "rows", "MAE", "RMSE", "sMAPE"]
    chosen = both.where("level = 'by_tag' and split = 'test' and model = 'a'")
    assert rows(chosen.select(*tag)) == rows(fc.metrics_by_tag(df, "a").select(*tag))


# Published validation and test errors of the compared models.
PUBLISHED = [
    ("validation", "linear_regression_pooled", 330, 126.37, 227.90, 40.02),
    ("test", "linear_regression_pooled", 300, 120.79, 208.13, 29.22),
    ("validation", "ridge_regression_pooled", 330, 130.62, 226.09, 41.45),
    ("test", "ridge_regression_pooled", 300, 117.16, 207.93, 27.45),
    ("validation", "random_forest_pooled", 330, 124.69, 228.41, 38.03),
    ("test", "random_forest_pooled", 300, 106.68, 190.43, 24.78),
    ("validation", "hist_gradient_boosting_pooled", 330, 124.14, 230.33, 38.28),
    ("test", "hist_gradient_boosting_pooled", 300, 107.29, 180.73, 25.66),
    ("validation", "baseline_last_value", 330, 147.65, 278.86, 44.96),
    ("test", "baseline_last_value", 300, 132.20, 260.08, 30.43),
]


def test_model_choice_on_published_metrics(spark):
    metrics = spark.createDataFrame(PUBLISHED, "split string, model string, rows long, MAE double, RMSE double, sMAPE double")
    assert fc.best_learned(metrics).first()["model"] == "random_forest_pooled"
    assert fc.best_test_reference(metrics).first()["sMAPE"] == 24.78
    assert fc.test_winner(metrics).first()["model"] == "random_forest_pooled"
    assert fc.metrics_of_best(metrics, fc.best_learned(metrics)).count() == 2
    assert rows(fc.best_per_split(metrics), "split", "model") == [("test", "random_forest_pooled"), ("validation", "random_forest_pooled")]
    times = spark.createDataFrame([("random_forest_pooled", 0.67), ("other", 1.0)], "model string, train_seconds double")
    assert [tuple(r) for r in fc.accuracy_vs_time(metrics, times).collect()] == [("random_forest_pooled", 24.78, 0.67)]


def test_replacing_a_run(spark):
    metrics = spark.createDataFrame(PUBLISHED[:2], "split string, model string, rows long, MAE double, RMSE double, sMAPE double")
    old = metrics.withColumn("run_label", F.lit("a")).unionByName(metrics.withColumn("run_label", F.lit("b")).withColumn("MAE", F.lit(0.0)))
    merged = fc.replace_run(old, metrics, "b")
    assert [(r["run_label"], r["split"], r["MAE"]) for r in merged.collect()] == [
        ("a", "test", 120.79), ("a", "validation", 126.37), ("b", "test", 120.79), ("b", "validation", 126.37)
    ]
    assert fc.replace_run(old.select("run_label", *fc.METRIC_COLUMNS), metrics.where("false"), "b").count() == 2


def test_epochs(spark):
    history = spark.createDataFrame([(1, 0.5, 9.0, 50.0), (2, 0.4, 8.0, 40.0), (3, 0.3, 7.0, 40.0), (4, 0.2, 7.5, 30.0), (5, 0.1, 7.0, 30.0)], "epoch long, train_loss double, validation_MAE double, validation_sMAPE double")
    assert [r["improved"] for r in fc.running_best(history).orderBy("epoch").collect()] == [True, True, False, True, False]
    assert fc.best_epoch(history).first()["epoch"] == 5
    assert fc.best_epoch(history.where("epoch < 5")).first()["epoch"] == 4
    curve = fc.learning_curve(history)
    assert curve.columns == ["epoch", "train_loss", "validation_sMAPE", "elapsed_seconds"] and curve.where("elapsed_seconds is null").count() == 5


def test_representative_tags_and_series(spark):
    df = predictions(spark)
    assert rows(fc.representative_tags(df), "tag_type", "tag") == [("cashtag", "$Z"), ("hashtag", "#x")]
    assert rows(fc.series_of(df.where("split = 'test'"), "hashtag", "#x", "b")) == [(DAY, 5.0, 3.0)]


def test_compare_errors(spark):
    df = predictions(spark)
    gap = fc.compare_errors(fc.metrics_by_tag(df, "a"), fc.metrics_by_tag(df, "b"), "a", "b", "MAE")
    assert rows(gap, "tag", "b_minus_a") == [("#x", 1.0), ("#y", -2.0), ("$Z", 3.0)]


def test_evaluation_rows_accept_other_names(spark):
    raw = spark.createDataFrame([("5", "7", "2020-07-01"), ("0", "0", "bad"), ("x", "1", None)], "y_true string, y_pred string, date string")
    got = dg.evaluation_rows(raw)
    assert rows(got, "actual", "prediction", "date", "tag", "tag_type", "split", "residual", "abs_error") == [
        (0.0, 0.0, None, "unknown_tag", "unknown", "unknown", 0.0, 0.0),
        (5.0, 7.0, DAY, "unknown_tag", "unknown", "unknown", 2.0, 2.0),
    ]
    assert sorted(r["row_smape"] for r in got.collect()) == [0.0, pytest.approx(200 * 2 / 12)]
    with pytest.raises(ValueError, match="actual"):
        dg.evaluation_rows(raw.drop("y_true"))


def test_alias_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "actual int, target_next_count int, predicted int")
    assert reshape.canonical_names(df).columns == ["actual", "target_next_count", "prediction"]


def test_diagnostics(spark):
    df = dg.evaluation_rows(predictions(spark).where("model = 'b' and split <> 'train'"))
    assert tuple(dg.residual_summary(df).first()) == (pytest.approx(-2.67, abs=0.01), -2.0)
    assert tuple(dg.axis_limit(df).first()) == (10.0,)
    misses = dg.worst_misses(df, 1)
    assert rows(misses, "side", "tag", "residual") == [("over", "#y", 0.0), ("under", "$Z", -6.0)]
    heat = dg.error_heat_map(df, 2)
    assert [r["tag_label"] for r in heat.collect()] == ["cashtag: $Z", "hashtag: #x"]
    assert len(heat.columns) == 5
    summary = dg.error_by_bucket(df)
    assert summary.where("measure = 'actual'").agg(F.sum("count")).first()[0] == 6


def test_heat_map_refuses_too_many_columns(spark):
    df = dg.evaluation_rows(predictions(spark))
    with pytest.raises(ValueError, match="more than 2 distinct values"):
        dg.error_heat_map(df, 2, max_dates=2)


def test_reshaping(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "model string, s double")
    mapped = reshape.rows_to_map(df, "model", "s")
    assert mapped.first()["map"] == {"a": 1.5, "b": 2.0}
    assert mapped.select(reshape.map_total(F.col("map"))).first()[0] == 3.5
    assert mapped.select(reshape.map_total(F.create_map().cast("map<string,double>"))).first()[0] is None
    nested = spark.createDataFrame([((1, ("x",)),)], "s struct<a: int, t: struct<b: string>>")
    flat = reshape.flatten_summary(nested, {"a": "s.a", "b": "s.t.b", "c": "s.t.c", "d": "q"}, {"d": "double"})
    assert flat.dtypes == [("a", "int"), ("b", "string"), ("c", "string"), ("d", "double")] and tuple(flat.first()) == (1, "x", None, None)
    wide = spark.createDataFrame([(1, 2, 3)], "pos_sentiment int, other int, sentiment_x int")
    assert reshape.columns_like(wide, "sentiment", "positive").columns == ["pos_sentiment", "sentiment_x"]


@pytest.mark.parametrize("n, want", [(0, []), (1, [0]), (3, [0, 1, 2]), (8, list(range(8))), (30, [0, 4, 8, 12, 16, 20, 24, 29]), (77, [0, 10, 21, 32, 43, 54, 65, 76])])
def test_evenly_spaced_dates(spark, n, want):
    df = spark.range(n).selectExpr("date_add(DATE'2020-01-01', cast(id as int)) AS date")
    assert [r["position"] for r in reshape.evenly_spaced_dates(df).orderBy("tick").collect()] == want
