"""From daily counts to a balanced panel of the top tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.operators.clean import between_dates
from tagloom.operators.counts import tag_summary
from tagloom.operators.ranking import membership, top_per_group
from tagloom.session import broadcast_if_bounded
from tagloom.sources.tables import with_tag_type

PANEL_KEYS = ["tag_type", "tag", "date"]
TAG_KEYS = ["tag_type", "tag"]


def union_counts(hashtags: DataFrame, cashtags: DataFrame) -> DataFrame:
    """Both daily count tables in long form."""
    return with_tag_type(hashtags, "hashtag").unionByName(with_tag_type(cashtags, "cashtag"))


def load_counts(hashtags: DataFrame, cashtags: DataFrame, start: str, end: str) -> DataFrame:
    """Long daily counts inside an inclusive date range."""
    return between_dates(union_counts(hashtags, cashtags), start, end)


def select_top_tags(
    counts: DataFrame, top_n: int = 15, min_observed_days: int = 60, unique_days: bool = False
) -> DataFrame:
    """The ``top_n`` tags of each type among those seen on enough days."""
    frequent = tag_summary(counts, unique_days).where(F.col("observed_days") >= min_observed_days)
    order = [F.desc("total_count"), F.desc("observed_days"), "tag"]
    return top_per_group(frequent, top_n, ["tag_type"], order)


def distinct_tags(df: DataFrame) -> DataFrame:
    return df.select(*TAG_KEYS).distinct()


def distinct_dates(df: DataFrame) -> DataFrame:
    """The observed dates, in order."""
    return df.select("date").where(F.col("date").isNotNull()).distinct().orderBy("date")


def date_positions(df: DataFrame) -> DataFrame:
    """Zero-based position of each observed date.

    The window has no partition, but it runs over the distinct dates only.
    """
    dates = df.select("date").where(F.col("date").isNotNull()).distinct()
    return dates.withColumn("date_position", F.row_number().over(W.orderBy("date")) - 1)


def date_spine(df: DataFrame) -> DataFrame:
    """One row: the sorted array of observed dates, at most one per calendar day.

    The dates are made distinct first: that aggregate is compiled, the one that
    builds the array is not.
    """
    return df.select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("dates"))


def panel_grid(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """Every selected tag on every observed date of *all* counts.

    The dates are a one-row subquery, exploded beside each tag: no join at all.
    """
    dates = date_spine(counts).scalar()
    return distinct_tags(selected).select(*TAG_KEYS, F.explode(dates).alias("date"))


def counts_of(counts: DataFrame, selected: DataFrame, selected_rows: int | None = None) -> DataFrame:
    """Daily counts of the selected tags only."""
    return membership(counts, broadcast_if_bounded(selected.select(*TAG_KEYS), selected_rows), TAG_KEYS)


def build_panel(counts: DataFrame, selected: DataFrame, selected_rows: int | None = None) -> DataFrame:
    """The grid with its counts; days without the tag count 0.

    ``selected_rows`` is a proven bound on the selection (top n times types); it
    lets the big count table be filtered by broadcast, without a shuffle.
    """
    own = counts_of(counts, selected, selected_rows)
    filled = panel_grid(counts, selected).join(own, PANEL_KEYS, "left").fillna(0, ["count"])
    return filled.select("date", "tag", "tag_type", "count")


def canonical_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*PANEL_KEYS)


def concat_all(frames: list[DataFrame]) -> DataFrame:
    """Union of frames that may lack some columns; those become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
