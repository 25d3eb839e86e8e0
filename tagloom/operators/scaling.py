"""Median imputation, standardisation and one-hot counts, fitted on the train split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arithmetic import at_least, finite_or_null
from tagloom.operators.quantiles import exact_quantiles, unpivoted


@dataclass(frozen=True)
class Scaling:
    """Per-column median, mean and population std; a handful of numbers."""

    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]

    def imputed(self, column: str) -> Column:
        return F.coalesce(finite_or_null(F.col(column).cast("double")), F.lit(self.medians[column]))

    def scaled(self, column: str) -> Column:
        return (self.imputed(column) - self.means[column]) / self.stds[column]

    def apply(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.scaled(c) for c in self.medians})


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(F.col(c).cast("double")) for c in columns})


def column_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``measure, median`` of each column, infinities and nulls left out."""
    long = unpivoted(finite_columns(train, columns), columns)
    return exact_quantiles(long, "value", [0.5], ["measure"]).select(
        "measure", F.get("quantiles", F.lit(0)).alias("median")
    )


def fit_scaling(train: DataFrame, columns: Sequence[str]) -> Scaling:
    """Statistics of the train rows; a column without values has median 0, a constant one std 1."""
    found = {row["measure"]: row["median"] for row in column_medians(train, columns).collect()}
    medians = {c: float(found.get(c, 0.0)) for c in columns}
    partial = Scaling(medians, {}, {})
    moments = train.agg(
        *[F.avg(partial.imputed(c)).alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(partial.imputed(c)).alias(f"std_{i}") for i, c in enumerate(columns)],
    ).first()
    means = {c: moments[f"mean_{i}"] for i, c in enumerate(columns)}
    stds = {c: moments[f"std_{i}"] or 1.0 for i, c in enumerate(columns)}
    return Scaling(medians, means, stds)


def split_moments(df: DataFrame, column: str, split: str = "train") -> DataFrame:
    """One row: mean and population std over one split, read in a single pass."""
    value = F.when(F.col("split") == split, F.col(column).cast("double"))
    std = F.stddev_pop(value)
    return df.agg(F.avg(value).alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))


def standardise_target(df: DataFrame, column: str, split: str = "train") -> DataFrame:
    """Add ``<column>_scaled``; mean and std come from one split, as a one-row subquery."""
    moments = split_moments(df, column, split).select(F.struct("mean", "std")).scalar()
    return df.withColumn(f"{column}_scaled", (F.col(column) - moments["mean"]) / moments["std"])


def restore_target(df: DataFrame, scaled: str, moments: Column, name: str) -> DataFrame:
    """Undo the standardisation and clip at 0, since counts are never negative."""
    return df.withColumn(name, at_least(F.col(scaled) * moments["std"] + moments["mean"], 0.0))
