"""Derived tables: daily counts, feature tables, optional artifacts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.dates import day_from_epoch, to_day
from tagloom.operators.quality import require_columns

COUNT_COLUMNS = ("date", "tag", "count")

# The model inputs.
TARGET = "target_next_count"
NUMERIC_FEATURES = (
    "count",
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
)
CATEGORICAL_FEATURES = ("tag", "tag_type")
MODELING_COLUMNS = ("date", *CATEGORICAL_FEATURES, TARGET, "split", "modeling_ready", *NUMERIC_FEATURES)


def with_tag_type(counts: DataFrame, tag_type: str) -> DataFrame:
    """Daily counts in long form; dates may arrive as DATE or as days since 1970."""
    require_columns(counts, COUNT_COLUMNS)
    numeric = isinstance(counts.schema["date"].dataType, T.NumericType)
    date = day_from_epoch(F.col("date")) if numeric else to_day(F.col("date"))
    return counts.select(
        date.alias("date"), "tag", F.lit(tag_type).alias("tag_type"), F.col("count").cast("long")
    )


def read_daily_counts(spark: SparkSession, path: str, tag_type: str) -> DataFrame:
    """Only date, tag and count are read from the file."""
    return with_tag_type(spark.read.parquet(path), tag_type)


def modeling_rows(features: DataFrame) -> DataFrame:
    """Rows fit for modelling, after checking that the needed columns exist."""
    require_columns(features, MODELING_COLUMNS)
    return features.where("modeling_ready")


def load_modeling_frame(spark: SparkSession, path: str) -> DataFrame:
    return modeling_rows(spark.read.parquet(path))


def read_if_exists(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """An optional CSV, Parquet or JSON artifact, or None where the path is absent."""
    options = {"header": True, "inferSchema": True} if fmt == "csv" else {}
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_first_existing(spark: SparkSession, paths: Sequence[str], fmt: str) -> DataFrame | None:
    """The first candidate that exists, in the given order."""
    found: Iterable[DataFrame | None] = (read_if_exists(spark, path, fmt) for path in paths)
    return next((df for df in found if df is not None), None)
