"""Forecast-error aggregates, to be used inside one ``agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.arithmetic import absolute_error, row_smape


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    return F.avg(absolute_error(actual, predicted))


def root_mean_squared_error(actual: Column, predicted: Column) -> Column:
    gap = predicted - actual
    return F.sqrt(F.avg(gap * gap))


def mean_smape(actual: Column, predicted: Column) -> Column:
    return F.avg(row_smape(actual, predicted))


def error_metrics(actual: str, predicted: str) -> list[Column]:
    """rows, MAE, RMSE and sMAPE of a (actual, predicted) pair of columns."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return [
        F.count(F.lit(1)).alias("rows"),
        mean_absolute_error(a, p).alias("MAE"),
        root_mean_squared_error(a, p).alias("RMSE"),
        mean_smape(a, p).alias("sMAPE"),
    ]
