"""Histograms, quantile buckets, equal-width buckets and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.arithmetic import at_most
from tagloom.operators.quantiles import exact_quantiles, global_quantile
from tagloom.session import broadcast_if_bounded


def clip_at_quantile(df: DataFrame, column: str, probability: float = 0.98) -> DataFrame:
    """Values above the quantile become the quantile."""
    return df.withColumn(column, at_most(F.col(column), global_quantile(df, column, probability)))


def value_range(df: DataFrame, column: str) -> DataFrame:
    """One row: lowest and highest value; a constant column gets a range of width one."""
    x = F.col(column).cast("double")
    found = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    pad = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    return found.select((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, lo, hi, rows`` of equal-width bins, empty ones included.

    Bins are closed on the left, the last one on both sides.
    """
    limits = value_range(df, column).select(F.struct("lo", "hi")).scalar()
    x, at, lo, hi = F.col("_x"), F.col("_b"), F.col("_range.lo"), F.col("_range.hi")
    width = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    # The division may land one bin off at an edge; the edges themselves decide.
    down = (x < lo + at * width).cast("int")
    up = ((x >= lo + (at + 1) * width) & (at < bins - 1)).cast("int")
    counted = (
        df.select(F.col(column).cast("double").alias("_x"))
        .where("_x is not null")
        .withColumn("_range", limits)
        .withColumn("_b", guess)
        .select((at - down + up).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    empty = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).alias("rows"))
    whole = counted.unionByName(empty).groupBy("bin").agg(F.sum("rows").alias("rows"))
    start = lambda n: lo + n * width
    return whole.withColumn("_range", limits).select(
        "bin",
        start(F.col("bin")).alias("lo"),
        F.when(F.col("bin") == bins - 1, hi).otherwise(start(F.col("bin") + 1)).alias("hi"),
        "rows",
    )


def _bucket_column(x: Column, edges: Column) -> Column:
    """Right-closed bucket of x between sorted edges; the lowest edge belongs to bucket 0."""
    inside = (x >= F.get(edges, F.lit(0))) & (x <= F.element_at(edges, -1))
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(inside & (F.size(edges) > 1), F.greatest(below - 1, F.lit(0)))


def _with_bucket(df: DataFrame, column: str, edges: Column, name: str) -> DataFrame:
    x = F.col(column).cast("double")
    bounds = F.struct(
        F.get("_edges", F.col(name)).alias("lo"), F.get("_edges", F.col(name) + 1).alias("hi")
    )
    return (
        df.withColumn("_edges", edges)
        .withColumn(name, _bucket_column(x, F.col("_edges")))
        .withColumn(f"{name}_bounds", F.when(F.col(name).isNotNull(), bounds))
        .drop("_edges")
    )


def quantile_edges(df: DataFrame, column: str, q: int = 4) -> DataFrame:
    """One row: the distinct quantile edges."""
    probabilities = [i / q for i in range(q + 1)]
    return exact_quantiles(df, column, probabilities).select(
        F.array_sort(F.array_distinct("quantiles")).alias("edges")
    )


def quantile_buckets(df: DataFrame, column: str, q: int = 4, name: str = "bucket") -> DataFrame:
    """Add a bucket id and its bounds; equal edges collapse, a constant column has no bucket."""
    return _with_bucket(df, column, quantile_edges(df, column, q).scalar(), name)


def equal_width_edges(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """One row: right-closed equal-width edges, the lowest moved out by 0.1 % of the range."""
    x = F.col(column).cast("double")
    found = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    pad = F.when(F.col("lo") == 0, F.lit(0.001)).otherwise(F.abs("lo") * 0.001)
    spread = found.select(
        F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("a"),
        F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("b"),
        flat.alias("flat"),
    )
    step = (F.col("b") - F.col("a")) / bins
    lowest = F.when(F.col("flat"), F.col("a")).otherwise(F.col("a") - (F.col("b") - F.col("a")) * 0.001)
    inner = [F.col("a") + i * step for i in range(1, bins)]
    return spread.select(F.array(lowest, *inner, F.col("b")).alias("edges"))


def equal_width_buckets(df: DataFrame, column: str, bins: int = 4, name: str = "bucket") -> DataFrame:
    return _with_bucket(df, column, equal_width_edges(df, column, bins).scalar(), name)


def box_plot(df: DataFrame, value: str, by: Sequence[str], groups: int | None = None) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers per group; rows beyond the whiskers are only left out of them.

    ``groups`` is a proven bound on the number of groups (such as the number of
    buckets): the quartiles then travel to the rows, not the rows to their group.
    """
    by = list(by)
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75], by).select(
        *by,
        F.get("quantiles", F.lit(0)).alias("q1"),
        F.get("quantiles", F.lit(1)).alias("median"),
        F.get("quantiles", F.lit(2)).alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(value).cast("double")
    joined = df.select(*by, value).join(broadcast_if_bounded(quartiles, groups), by)
    fenced = joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(x >= F.col("q1") - reach, x)).alias("_lo"),
        F.max(F.when(x <= F.col("q3") + reach, x)).alias("_hi"),
    )
    return fenced.select(
        *by,
        F.least("_lo", "q1").alias("whisker_low"),
        "q1",
        "median",
        "q3",
        F.greatest("_hi", "q3").alias("whisker_high"),
    )
