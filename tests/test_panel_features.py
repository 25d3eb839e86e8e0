from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tagloom.operators import features as ft, panel, quality, splits
from tagloom.plans.feature_table import PanelSettings, feature_table, features_from_daily, validate
from tests.conftest import rows

DAY = dt.date(2020, 4, 9)
COUNTS = [4, 0, 6, 6, 2, 9, 3, 8, 5]
# One tag on nine observed dates; None where the value is not defined.
EXPECTED = {
    "target_next_count": [0, 6, 6, 2, 9, 3, 8, 5, None],
    "count_lag_1": [None, 4, 0, 6, 6, 2, 9, 3, 8],
    "count_lag_7": [None] * 7 + [4, 0],
    "rolling_mean_3": [None, None, 3.333333, 4, 4.666667, 5.666667, 4.666667, 6.666667, 5.333333],
    "rolling_std_3": [None, None, 3.055050, 3.464102, 2.309401, 3.511885, 3.785939, 3.214550, 2.516611],
    "rolling_mean_7": [None] * 6 + [4.285714, 4.857143, 5.571429],
    "rolling_std_7": [None] * 6 + [2.984085, 3.287784, 2.507133],
    "count_diff_1": [None, -4, 6, 0, -4, 7, -6, 5, -3],
    "count_pct_change_1": [None, -1, 0, 0, -0.666667, 3.5, -0.666667, 1.666667, -0.375],
    "anomaly_z_ready_7": [None] * 6 + [-0.430857, 0.955920, -0.227921],
}


def panel_of(spark, series: dict[str, list[int]], gap: int = 1):
    data = [(DAY + dt.timedelta(days=i * gap), tag, "hashtag", n) for tag, ns in series.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(data, "date date, tag string, tag_type string, count long")


@pytest.mark.parametrize("gap", [1, 3])
def test_window_fixture(spark, gap):
    """Steps are observed dates: gaps in the calendar change nothing but the weekday."""
    df = ft.add_modeling_ready(ft.add_features(panel_of(spark, {"#a": COUNTS, "#flat": [5] * 9}, gap)))
    got = df.where("tag = '#a'").orderBy("date").collect()
    for column, values in EXPECTED.items():
        for row, want in zip(got, values):
            have = row[column]
            assert (have is None) == (want is None), column
            assert want is None or math.isclose(have, want, abs_tol=1e-6), column
    assert [r["day_index"] for r in got] == list(range(9))
    assert [r["day_of_week"] for r in got] == [(DAY + dt.timedelta(days=i * gap)).weekday() for i in range(9)]
    assert [r["modeling_ready"] for r in got] == [False] * 7 + [True, False]
    flat = df.where("tag = '#flat'").orderBy("date").collect()
    assert flat[8]["anomaly_trailing_std_7"] == 0 and flat[8]["anomaly_z_ready_7"] is None
    assert flat[8]["count_pct_change_1"] == 0.0


def test_feature_types(spark):
    types = dict(ft.add_features(panel_of(spark, {"#a": COUNTS})).dtypes)
    assert types["count"] == "bigint" and types["day_index"] == types["day_of_week"] == "int"
    assert all(types[c] == "double" for c in EXPECTED)


def test_features_need_one_sort(spark):
    plan = ft.add_features(panel_of(spark, {"#a": COUNTS}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_panel_spans_the_dates_of_all_tags(spark):
    data = [
        (DAY, "#a", "hashtag", 3),
        (DAY + dt.timedelta(days=2), "#a", "hashtag", 1),
        (DAY + dt.timedelta(days=5), "$B", "cashtag", 7),
        (DAY + dt.timedelta(days=6), "#rare", "hashtag", 9),
    ]
    counts = spark.createDataFrame(data, "date date, tag string, tag_type string, count long")
    chosen = counts.where("tag in ('#a', '$B')")
    built = panel.build_panel(counts, chosen, 2)
    assert built.count() == 8
    assert rows(built.where("count > 0")) == rows(counts.where("tag <> '#rare'"))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_top_tags_and_ties(spark):
    data = []
    for tag, days, n in [("#b", 3, 2), ("#a", 3, 2), ("#c", 2, 3), ("#d", 1, 99)]:
        data += [(DAY + dt.timedelta(days=i), tag, "hashtag", n) for i in range(days)]
    counts = spark.createDataFrame(data, "date date, tag string, tag_type string, count long")
    top = panel.select_top_tags(counts, top_n=2, min_observed_days=2)
    assert rows(top, "tag", "total_count", "observed_days") == [("#a", 6, 3), ("#b", 6, 3)]


def test_split_arithmetic(spark):
    """77 dates and 30 tags give 1440, 330 and 300 rows fit for modelling."""
    dates = spark.range(77).selectExpr("date_add(DATE'2020-04-09', cast(id + id div 4 as int)) AS date", "id")
    tags = spark.range(30).selectExpr("if(id < 15, 'hashtag', 'cashtag') AS tag_type", "concat('t', id) AS tag", "id AS n")
    counts = tags.withColumn("one", F.lit(1)).join(dates.withColumn("one", F.lit(1)), "one").selectExpr(
        "date", "tag", "tag_type", "(id * 7 + n * 3) % 11 + 1 AS count"
    )
    features = feature_table(counts, PanelSettings())
    validate(features, PanelSettings(), {"train": 1440, "validation": 330, "test": 300}, dates=77)
    with pytest.raises(ValueError, match="rows per split"):
        validate(features, PanelSettings(), {"train": 1, "validation": 330, "test": 300})
    with pytest.raises(ValueError, match="selected tags"):
        validate(features, PanelSettings(top_n=14))


def test_splits_in_place_equal_the_calendar_join(spark):
    df = panel_of(spark, {"#a": COUNTS, "#b": COUNTS})
    in_place = splits.add_splits(df, 5, 2).select("date", "tag", "split")
    joined = splits.join_splits(df, splits.split_calendar(df, 5, 2)).select("date", "tag", "split")
    assert rows(in_place) == rows(joined)
    assert rows(in_place.groupBy("split").count()) == [("test", 4), ("train", 10), ("validation", 4)]
    assert rows(splits.add_splits(df, 50, 2).select("split").distinct()) == [("train",)]
    undated = df.withColumn("date", F.when(F.col("count") > 4, F.col("date")))
    assert undated.transform(splits.add_splits, 1, 1).where("date is null").select("split").distinct().first()[0] is None


def test_daily_tables_to_features(spark):
    h = spark.createDataFrame([(18361 + i, "#a", c) for i, c in enumerate(COUNTS)], "date int, tag string, count long")
    c = spark.createDataFrame([(18361 + i, "$A", 1) for i in range(9)], "date int, tag string, count long")
    settings = PanelSettings(top_n=1, min_observed_days=2, train_dates=8, validation_dates=1)
    features = features_from_daily(h, c, settings)
    assert features.count() == 18
    assert features.where("modeling_ready").count() == 2
    assert quality.target_mismatches(features).isEmpty()


def test_quality_checks(spark):
    df = panel_of(spark, {"#a": [1, 2], "#b": [3]})
    assert quality.missing_columns(df, ["tag", "x"]) == ["x"]
    with pytest.raises(ValueError, match="missing columns"):
        quality.require_columns(df, ["x"])
    with pytest.raises(ValueError, match="no rows"):
        quality.require_rows(df.where("false"), "empty")
    assert rows(quality.count_violations(df, "tag", {"#a": 2, "#b": 2, "#c": 1})) == [("#b", 1, 2), ("#c", 0, 1)]
    assert rows(quality.count_violations(df, "tag", {"#a": 2})) == [("#b", 1, 0)]
    assert rows(quality.duplicate_keys(df.union(df.where("tag = '#b'")), ["tag", "date"]), "tag", "copies") == [("#b", 2)]
    with pytest.raises(ValueError, match="expected 4 rows"):
        quality.require_row_total(df, 4, "panel")
    assert quality.all_null(df.withColumn("x", F.lit(None)), "x") and not quality.all_null(df, "count")
    broken = ft.add_features(df).withColumn("target_next_count", F.lit(7.0))
    assert rows(quality.target_mismatches(broken), "tag", "expected") == [("#a", 2.0), ("#a", None), ("#b", None)]


def test_features_equal_pandas_on_random_counts(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(17)
    series = {f"#t{i}": (rng.integers(0, 6, 40) * rng.integers(0, 2, 40)).tolist() for i in range(4)}
    got = ft.add_features(panel_of(spark, series, gap=2)).orderBy("tag", "date").toPandas()
    for tag, rows_ in got.groupby("tag"):
        c = pd.Series(series[tag], dtype=float)
        want = {f"count_lag_{k}": c.shift(k) for k in (1, 2, 3, 7)}
        want |= {f"rolling_mean_{n}": c.rolling(n, min_periods=n).mean() for n in (3, 7)}
        want |= {f"rolling_std_{n}": c.rolling(n, min_periods=n).std() for n in (3, 7)}
        want["target_next_count"] = c.shift(-1)
        want["count_diff_1"] = c - c.shift(1)
        change = (c - c.shift(1)) / c.shift(1)
        want["count_pct_change_1"] = change.where(c.shift(1) != 0, 0.0).where(c.shift(1).notna())
        std = c.rolling(7, min_periods=7).std()
        want["anomaly_z_ready_7"] = ((c - want["rolling_mean_7"]) / std).where(std > 1e-9)
        for column, values in want.items():
            np.testing.assert_allclose(rows_[column].to_numpy(dtype=float), values.to_numpy(), atol=1e-6, err_msg=column)


def test_days_may_be_counted_where_they_are_unique(spark):
    from tagloom.operators.counts import tag_summary

    df = panel_of(spark, {"#a": COUNTS, "#b": [1, 2]})
    assert rows(tag_summary(df, unique_days=True)) == rows(tag_summary(df)) == [("hashtag", "#a", 43, 9), ("hashtag", "#b", 3, 2)]
    doubled = tag_summary(df.union(df))
    assert rows(doubled, "observed_days") == [(2,), (9,)]
    plan = tag_summary(df, unique_days=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_duplicate_days_are_found(spark):
    df = panel_of(spark, {"#a": COUNTS})
    cash = df.withColumn("tag_type", F.lit("cashtag"))
    settings = PanelSettings(top_n=1, min_observed_days=1, train_dates=5, validation_dates=2)
    features = feature_table(df.union(df).union(cash), settings)
    with pytest.raises(ValueError, match="duplicate keys"):
        validate(features, settings)
