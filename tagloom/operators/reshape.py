"""Pivots, unpivots and column bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted column names, in order of preference, and (type, default) of absent ones.
PREDICTION_ALIASES = {
    "target_next_count": "actual",
    "actual": "actual",
    "y_true": "actual",
    "prediction": "prediction",
    "y_pred": "prediction",
    "predicted": "prediction",
}
PREDICTION_DEFAULTS = {
    "date": ("date", None),
    "tag": ("string", "unknown_tag"),
    "tag_type": ("string", "unknown"),
    "split": ("string", "unknown"),
}


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def canonical_names(df: DataFrame, aliases: Mapping[str, str] = PREDICTION_ALIASES) -> DataFrame:
    """Rename by an ordered alias map; a target name that is taken is left alone."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def add_missing(
    df: DataFrame, defaults: Mapping[str, tuple[str, object]] = PREDICTION_DEFAULTS
) -> DataFrame:
    """Add absent columns as typed constants."""
    absent = {c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def with_constants(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def columns_like(df: DataFrame, *parts: str, keep: Sequence[str] = ()) -> DataFrame:
    """Only the columns whose name contains one of the parts."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and any(p in c for p in parts)])


def pivot_values(
    df: DataFrame, index: Sequence[str], column: str, value: Column, values: Sequence[object]
) -> DataFrame:
    """Pivot over known column values, which spares Spark the job that would list them."""
    return df.groupBy(*index).pivot(column, list(values)).agg(value)


def known_values(df: DataFrame, column: str, bound: int) -> list:
    """Distinct values that become column names; refuses more than ``bound`` of them."""
    rows = df.select(column).distinct().orderBy(column).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} distinct values in {column}")
    return [row[0] for row in rows]


def flatten_summary(
    summary: DataFrame, fields: Mapping[str, str], defaults: Mapping[str, str] | None = None
) -> DataFrame:
    """One flat row of a nested summary: ``{name: path}``, absent paths give null.

    ``defaults`` names the type of such nulls, string unless told otherwise.
    """
    types = defaults or {}

    def present(path: str) -> bool:
        level: T.DataType = summary.schema
        for name in path.split("."):
            if not isinstance(level, T.StructType) or name not in level.fieldNames():
                return False
            level = level[name].dataType
        return True

    picked = [
        F.col(path).alias(name) if present(path) else F.lit(None).cast(types.get(name, "string")).alias(name)
        for name, path in fields.items()
    ]
    return summary.select(*picked)


def map_total(map_column: Column) -> Column:
    """Sum of a map's values; an empty or missing map gives null."""
    total = F.aggregate(F.map_values(map_column), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(map_column) > 0, total)


def rows_to_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: a map from a table that has one row per key, such as one per model."""
    entries = F.array_sort(F.collect_list(F.struct(key, value)))
    return df.agg(F.map_from_entries(entries).alias("map"))


def evenly_spaced_dates(df: DataFrame, ticks: int = 8) -> DataFrame:
    """Up to ``ticks`` positions spread over the sorted distinct dates."""
    dates = df.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    sized = dates.select("dates", F.size("dates").alias("n")).where("n > 0")
    tick = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(ticks)) - 1))
    # Whole-number form of a linear spacing from the first to the last position.
    steps = F.greatest(F.least(F.col("n"), F.lit(ticks)) - 1, F.lit(1))
    position = F.floor(F.col("tick") * (F.col("n") - 1) / steps).cast("int")
    return sized.select("dates", "n", tick.alias("tick")).select(
        "tick", position.alias("position"), F.get("dates", position).alias("date")
    )
