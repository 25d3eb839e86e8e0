"""Guarded arithmetic and row-level error measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_ratio(difference: Column, base: Column) -> Column:
    """difference / base; 0 where the base is 0, null where the base is missing."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.try_divide(difference, base))


def standard_score(deviation: Column, spread: Column) -> Column:
    """deviation / spread where the spread is positive, else null."""
    return F.when(spread > 0, F.try_divide(deviation, spread))


def at_least(value: Column, floor: float | Column) -> Column:
    """Clip below; unlike ``greatest`` a null stays null."""
    bound = floor if isinstance(floor, Column) else F.lit(floor)
    return F.when(value < bound, bound).otherwise(value)


def at_most(value: Column, ceiling: float | Column) -> Column:
    """Clip above; unlike ``least`` a null stays null."""
    bound = ceiling if isinstance(ceiling, Column) else F.lit(ceiling)
    return F.when(value > bound, bound).otherwise(value)


def finite_or_null(value: Column) -> Column:
    """Infinities and NaN become null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def residual(actual: Column, predicted: Column) -> Column:
    return predicted - actual


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(predicted - actual)


def row_smape(actual: Column, predicted: Column) -> Column:
    """Symmetric percentage error of one row; 0 where both values are 0."""
    scale = F.abs(actual) + F.abs(predicted)
    ratio = F.try_divide(F.lit(200.0) * F.abs(predicted - actual), scale)
    return F.when(scale == 0, F.lit(0.0)).otherwise(ratio)


def all_present(columns: list[str]) -> Column:
    """True where every listed column is non-null."""
    return reduce(lambda left, right: left & right, [F.col(c).isNotNull() for c in columns])
