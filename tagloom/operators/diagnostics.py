"""Where a model errs: residuals, worst rows, heat maps and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arithmetic import absolute_error, residual, row_smape
from tagloom.functions.dates import to_day
from tagloom.functions.text import tag_label
from tagloom.operators.buckets import quantile_buckets
from tagloom.operators.clean import numeric_pairs
from tagloom.operators.quality import require_columns
from tagloom.operators.quantiles import exact_quantiles, measure_summary
from tagloom.operators.ranking import extremes, membership, top_k
from tagloom.operators.reshape import add_missing, canonical_names, known_values

DETAIL_KEYS = ("tag_type", "tag", "date")


def evaluation_rows(predictions: DataFrame) -> DataFrame:
    """Canonical names and types, plus residual, absolute error and row sMAPE."""
    named = require_columns(canonical_names(predictions), ["actual", "prediction"])
    typed = add_missing(named).withColumn("date", to_day(F.col("date")))
    actual, predicted = F.col("actual"), F.col("prediction")
    return numeric_pairs(typed).withColumns(
        {
            "residual": residual(actual, predicted),
            "abs_error": absolute_error(actual, predicted),
            "row_smape": row_smape(actual, predicted),
        }
    )


def residual_summary(evaluated: DataFrame, digits: int = 2) -> DataFrame:
    """One row: mean and median residual."""
    median = exact_quantiles(evaluated, "residual", [0.5]).select(F.get("quantiles", F.lit(0))).scalar()
    return evaluated.agg(F.round(F.avg("residual"), digits).alias("mean_residual")).withColumn(
        "median_residual", F.round(median, digits)
    )


def worst_misses(evaluated: DataFrame, k: int = 8) -> DataFrame:
    """The k largest over- and under-predictions."""
    return extremes(evaluated, k, "residual", DETAIL_KEYS, ("over", "under"))


def axis_limit(evaluated: DataFrame) -> DataFrame:
    """One row: the largest actual or predicted value."""
    return evaluated.agg(F.greatest(F.max("actual"), F.max("prediction")).alias("axis_limit"))


def top_volume_tags(evaluated: DataFrame, k: int = 12) -> DataFrame:
    totals = evaluated.groupBy("tag_type", "tag").agg(F.sum("actual").alias("volume"))
    return top_k(totals, k, [F.desc("volume"), "tag_type", "tag"])


def error_by_tag_and_date(evaluated: DataFrame, k: int = 12) -> DataFrame:
    """Mean row sMAPE per date of the k tags with the largest volume, in long form."""
    top = top_volume_tags(evaluated, k)
    rows = membership(evaluated, top, ["tag_type", "tag"])
    means = rows.groupBy("tag_type", "tag", "date").agg(F.avg("row_smape").alias("row_smape"))
    return means.join(top, ["tag_type", "tag"]).select(
        tag_label(F.col("tag_type"), F.col("tag")).alias("tag_label"), "volume", "date", "row_smape"
    )


def error_heat_map(evaluated: DataFrame, k: int = 12, max_dates: int = 4000) -> DataFrame:
    """The same as a table with one column per date, largest volume first."""
    long = error_by_tag_and_date(evaluated, k)
    dates = known_values(evaluated.where(F.col("date").isNotNull()), "date", max_dates)
    wide = long.groupBy("tag_label", "volume").pivot("date", dates).agg(F.avg("row_smape"))
    return wide.orderBy(F.desc("volume"), "tag_label")


def error_by_bucket(
    evaluated: DataFrame,
    column: str = "actual",
    measures: Sequence[str] = ("actual", "row_smape", "abs_error"),
    q: int = 4,
) -> DataFrame:
    """Count, mean and median of the measures per quantile bucket of a column."""
    bucketed = quantile_buckets(evaluated, column, q).where(F.col("bucket").isNotNull())
    return measure_summary(bucketed, measures, ["bucket"])
