"""Sorts, top-k, top-n per group and best rows, always with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Above this many rows per group Spark's own per-task limit for ranked windows is off.
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64


def by_count(df: DataFrame, key: str, count: str = "count") -> DataFrame:
    """Highest count first, ties by key."""
    return df.orderBy(F.desc(count), key)


def by_date_and_count(df: DataFrame, date: str = "date") -> DataFrame:
    return df.orderBy(date, F.desc("count"), "tag")


def top_k(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first k rows of a total order; each task keeps only k rows."""
    return df.orderBy(*order).limit(k)


def top_k_reversed(df: DataFrame, k: int, measure: str, keys: Sequence[str]) -> DataFrame:
    """The k largest by a measure, shown smallest first (bar charts)."""
    best = top_k(df, k, [F.desc(measure), *keys])
    return best.orderBy(measure, *[F.desc(key) for key in keys])


def extremes(df: DataFrame, k: int, measure: str, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """The k highest and the k lowest rows, labelled in ``side``."""
    high = top_k(df, k, [F.desc(measure), *keys]).withColumn("side", F.lit(names[0]))
    low = top_k(df, k, [F.asc(measure), *keys]).withColumn("side", F.lit(names[1]))
    return high.unionByName(low)


def _first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def top_per_group(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first n rows of every group.

    Spark limits each task's share to n rows before the shuffle as long as n is
    below its threshold.  Beyond it a first round over salted groups does the
    same, so that a huge group is never ranked as a whole in one task.
    """
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000"))
    if n <= limit:
        return _first_rows(df, by, order, n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    return _first_rows(_first_rows(salted, [*by, "_salt"], order, n).drop("_salt"), by, order, n)


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each group with the smallest ``order`` values; reduced per task first."""
    rest = [c for c in df.columns if c not in by]
    rank = F.struct(*order)
    best = F.min_by(F.struct(*rest), rank).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, "_best.*").select(*df.columns)


def membership(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``members``; no list is brought to the driver."""
    return df.join(members.select(*keys), list(keys), "left_semi")


def share_of_total(df: DataFrame, measure: str, name: str = "share") -> DataFrame:
    """Percent of the total, for a table already cut to its top k rows."""
    total = F.sum(measure).over(W.partitionBy(F.lit(1)))
    return df.withColumn(name, F.col(measure) * 100.0 / total)
