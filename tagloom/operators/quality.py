"""Checks that raise, and checks that return their violations as rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def observed(df: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that the next pass over it computes on the way, such as its write.

    ``Observation.get`` has them once that pass has ended.
    """
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


def size_metrics(ready: str, split: str, date: str, splits: Iterable[str], first: str) -> dict[str, Column]:
    """Rows, ready rows of each split, and distinct dates from ``first`` on.

    Dates are counted as bits, which partial aggregates merge; 32,768 days fit.
    """
    day = F.datediff(F.col(date), F.lit(first)) + 1
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.when(day.between(1, 32_768), day)))
    rows = {f"rows_{s}": F.count_if(F.col(ready) & (F.col(split) == s)) for s in splits}
    return {"rows": F.count(F.lit(1)), **rows, "dates": F.bitmap_count(bits), "undated": F.count_if(~F.coalesce(day.between(1, 32_768), F.lit(False)))}


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when nothing is left; stops at the first row found."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def has_rows(df: DataFrame, condition: Column | str) -> bool:
    return not df.where(condition).isEmpty()


def all_null(df: DataFrame, column: str) -> bool:
    return df.where(F.col(column).isNotNull()).isEmpty()


def count_violations(df: DataFrame, column: str, expected: Mapping[str, int]) -> DataFrame:
    """Values of ``column`` whose row count differs from the expected one.

    A value that should be there but is not counts as 0, and an unexpected
    value has expected 0.
    """
    wanted = F.create_map(*[F.lit(x) for item in expected.items() for x in item])
    listed = F.explode(F.array(*[F.lit(name) for name in expected]))
    zeros = df.sparkSession.range(1).select(listed.alias(column), F.lit(0).alias("_one"))
    seen = df.select(F.col(column).cast("string"), F.lit(1).alias("_one"))
    actual = seen.unionByName(zeros).groupBy(column).agg(F.sum("_one").alias("actual"))
    target = F.coalesce(F.try_element_at(wanted, F.col(column)), F.lit(0)).cast("long")
    return actual.select(column, "actual", target.alias("expected")).where("actual <> expected")


def distinct_count_violations(
    df: DataFrame, group: str, value: str, expected: Mapping[str, int]
) -> DataFrame:
    """Groups whose number of distinct values differs from the expected one."""
    return count_violations(df.select(group, value).distinct(), group, expected)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def target_mismatches(
    features: DataFrame,
    target: str = "target_next_count",
    absolute: float = 1e-8,
    relative: float = 1e-5,
) -> DataFrame:
    """Rows whose stored target differs from the next day's count of the tag."""
    by_tag = W.partitionBy("tag_type", "tag").orderBy("date")
    checked = features.select(
        "tag_type", "tag", "date", target, F.lead("count").over(by_tag).cast("double").alias("expected")
    )
    stored = F.coalesce(F.col(target), F.lit(-1.0))
    wanted = F.coalesce(F.col("expected"), F.lit(-1.0))
    close = F.abs(stored - wanted) <= F.lit(absolute) + F.lit(relative) * F.abs(wanted)
    return checked.where(~close)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """One row: how many distinct values a column has."""
    return df.agg(F.count_distinct(column).alias("distinct_values"))


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def require_no_violations(violations: DataFrame, what: str, show: int = 20) -> None:
    """Raise with the first few violations in the message."""
    first = violations.limit(show).collect()
    if first:
        raise ValueError(f"{what}: {[row.asDict() for row in first]}")


def require_row_total(df: DataFrame, expected: int, what: str) -> None:
    actual = df.count()
    if actual != expected:
        raise ValueError(f"{what}: expected {expected} rows, found {actual}")
