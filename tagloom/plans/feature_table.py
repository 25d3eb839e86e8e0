"""Daily counts to the checked feature table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tagloom.operators.features import LAGS, add_features, add_modeling_ready
from tagloom.operators.panel import build_panel, load_counts, select_top_tags
from tagloom.operators.quality import (
    count_violations,
    distinct_count_violations,
    duplicate_keys,
    observed,
    require_no_violations,
    require_rows,
    size_metrics,
    target_mismatches,
)
from tagloom.operators.splits import add_splits
from tagloom.session import staged

TAG_TYPES = ("hashtag", "cashtag")
SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class PanelSettings:
    start: str = "2020-04-09"
    end: str = "2020-07-16"
    top_n: int = 15
    min_observed_days: int = 60
    train_dates: int = 55
    validation_dates: int = 11

    @property
    def selected_rows(self) -> int:
        return self.top_n * len(TAG_TYPES)


def panel_from_counts(counts: DataFrame, settings: PanelSettings) -> DataFrame:
    """``counts`` has one row per date, tag and type; ``validate`` finds it if not."""
    selected = select_top_tags(counts, settings.top_n, settings.min_observed_days, unique_days=True)
    return build_panel(counts, selected, settings.selected_rows)


def feature_table(counts: DataFrame, settings: PanelSettings) -> DataFrame:
    """Long daily counts to features.

    ``counts`` is read for the ranking, the date list and the panel: pass a staged
    or stored table.  The panel spans the dates of all counts, so their calendar
    decides the splits and the panel itself is built once.
    """
    panel = panel_from_counts(counts, settings)
    split = add_splits(panel, settings.train_dates, settings.validation_dates, dates_of=counts)
    return add_modeling_ready(add_features(split))


def features_from_daily(hashtags: DataFrame, cashtags: DataFrame, settings: PanelSettings) -> DataFrame:
    """Both daily count tables to the feature table."""
    counts = load_counts(hashtags, cashtags, settings.start, settings.end)
    return feature_table(staged(counts, "counts"), settings)


def staged_features(features: DataFrame, settings: PanelSettings) -> tuple[DataFrame, dict]:
    """The feature table written once, and what its write counted: rows, ready rows of each split, dates."""
    metrics = size_metrics("modeling_ready", "split", "date", SPLITS, settings.start)
    rows, seen = observed(features, metrics)
    return staged(rows, "features"), seen.get


def expected_split_rows(settings: PanelSettings, dates: int) -> dict[str, int]:
    """Ready rows of each split: a tag's first dates lack the longest lag, its last one the target."""
    bounds = [0, settings.train_dates, settings.train_dates + settings.validation_dates, dates]
    ready = range(max(LAGS), dates - 1)
    return {
        name: settings.selected_rows * len(range(max(lo, ready.start), max(lo, ready.start, min(hi, ready.stop))))
        for name, lo, hi in zip(SPLITS, bounds, bounds[1:])
    }


def validate(
    features: DataFrame,
    settings: PanelSettings,
    split_rows: dict[str, int] | None = None,
    dates: int | None = None,
) -> DataFrame:
    """Raise unless the table has the expected tags, keys, targets and sizes."""
    require_rows(features, "feature table")
    tags = {t: settings.top_n for t in TAG_TYPES}
    require_no_violations(distinct_count_violations(features, "tag_type", "tag", tags), "selected tags")
    require_no_violations(duplicate_keys(features, ["date", "tag_type", "tag"]), "duplicate keys")
    require_no_violations(target_mismatches(features), "next-day target")
    if dates is not None and features.select("date").distinct().count() != dates:
        raise ValueError(f"expected {dates} observed dates")
    if split_rows is not None:
        ready = features.where("modeling_ready")
        require_no_violations(count_violations(ready, "split", split_rows), "rows per split")
    return features


def validate_counted(
    features: DataFrame, settings: PanelSettings, counted: Mapping[str, int], dates: int | None = None
) -> DataFrame:
    """``validate`` with the sizes that the table's write counted, so no size needs a pass of its own.

    ``dates`` is the number of dates that must be there; the rows of each split follow
    from the dates that are.
    """
    if counted["undated"]:
        raise ValueError(f"{counted['undated']} rows without a date in range")
    if dates is not None and counted["dates"] != dates:
        raise ValueError(f"expected {dates} observed dates, found {counted['dates']}")
    validate(features, settings)
    expected = expected_split_rows(settings, counted["dates"])
    found = {name: counted[f"rows_{name}"] for name in SPLITS}
    if found != expected:
        raise ValueError(f"rows per split: expected {expected}, found {found}")
    return features
