"""Lags, rolling windows and anomaly scores of a panel.

All windows share one partitioning and order, so Spark needs one exchange and
one sort.  Steps are rows, that is observed dates, never calendar days.  In a
balanced panel every tag has the same number of rows: no tag is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tagloom.functions.arithmetic import all_present, change_ratio, standard_score
from tagloom.functions.dates import monday_zero

LAGS = (1, 2, 3, 7)
WINDOWS = (3, 7)

# What a row needs to be fit for modelling.
REQUIRED_FOR_MODELING = (
    "target_next_count",
    "count_lag_1",
    "count_lag_2",
    "count_lag_3",
    "count_lag_7",
    "rolling_mean_3",
    "rolling_mean_7",
    "rolling_std_3",
    "rolling_std_7",
    "count_diff_1",
    "count_pct_change_1",
    "day_of_week",
    "day_index",
)


def tag_history() -> WindowSpec:
    return W.partitionBy("tag_type", "tag").orderBy("date")


def next_value(value: str = "count") -> Column:
    return F.lead(value, 1).over(tag_history()).cast("double")


def lagged(k: int, value: str = "count") -> Column:
    return F.lag(value, k).over(tag_history()).cast("double")


def _full(n: int, value: str, aggregate: Column) -> Column:
    """An aggregate over the last n rows, null until n values are there."""
    frame = tag_history().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, aggregate.over(frame))


def rolling_mean(n: int, value: str = "count") -> Column:
    return _full(n, value, F.avg(value))


def rolling_std(n: int, value: str = "count") -> Column:
    """Sample standard deviation."""
    return _full(n, value, F.stddev_samp(value))


def row_position() -> Column:
    return F.row_number().over(tag_history()) - 1


def add_features(
    panel: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, anomaly: int = 7
) -> DataFrame:
    """Target, lags, rolling statistics, changes, calendar columns and anomaly score."""
    rolled = sorted({*windows, anomaly})
    windowed = {
        "target_next_count": next_value(),
        **{f"count_lag_{k}": lagged(k) for k in sorted({1, *lags})},
        **{f"rolling_mean_{n}": rolling_mean(n) for n in rolled},
        **{f"rolling_std_{n}": rolling_std(n) for n in rolled},
        "day_index": row_position(),
    }
    mean, std = F.col(f"rolling_mean_{anomaly}"), F.col(f"rolling_std_{anomaly}")
    return (
        panel.withColumns(windowed)
        .withColumn("count_diff_1", F.col("count") - F.col("count_lag_1"))
        .withColumns(
            {
                "count_pct_change_1": change_ratio(F.col("count_diff_1"), F.col("count_lag_1")),
                "day_of_week": monday_zero(F.col("date")),
                f"anomaly_trailing_mean_{anomaly}": mean,
                f"anomaly_trailing_std_{anomaly}": std,
                f"anomaly_deviation_{anomaly}": F.col("count") - mean,
                f"anomaly_z_ready_{anomaly}": standard_score(F.col("count") - mean, std),
            }
        )
    )


def add_modeling_ready(
    features: DataFrame, required: Sequence[str] = REQUIRED_FOR_MODELING
) -> DataFrame:
    return features.withColumn("modeling_ready", all_present(list(required)))
