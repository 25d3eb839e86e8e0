"""The tables behind the charts: activity, panel overview, model comparison, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dates import iso_day
from tagloom.functions.text import tag_label
from tagloom.operators import buckets, counts, diagnostics as dg, forecasts as fc, ranking as rk, reshape
from tagloom.operators.panel import canonical_order, concat_all
from tagloom.operators.quantiles import describe_columns
from tagloom.operators.splits import SPLIT_ORDER
from tagloom.session import staged

MAX_COLUMNS = 4000


def _top_tags(daily: DataFrame, k: int) -> DataFrame:
    return rk.top_k(counts.totals_by(daily, "tag"), k, [F.desc("count"), "tag"])


def trend_of_top_tags(daily: DataFrame, k: int = 5) -> DataFrame:
    """One row per date and one column per top tag, 0 where a tag is absent."""
    dated = daily.where(F.col("date").isNotNull())
    names = [row["tag"] for row in _top_tags(dated, k).collect()]
    kept = dated.where(F.col("tag").isin(names))
    return reshape.pivot_values(kept, ["date"], "tag", F.avg("count"), names).fillna(0.0).orderBy("date")


def weekly_heat_map(weekly: DataFrame, k: int = 10) -> DataFrame:
    """One row per top tag and one column per week, 0 where a tag is absent."""
    dated = weekly.where(F.col("week").isNotNull()).withColumn("week", iso_day(F.col("week")))
    weeks = reshape.known_values(dated, "week", MAX_COLUMNS)
    kept = rk.membership(dated, _top_tags(dated, k), ["tag"])
    return reshape.pivot_values(kept, ["tag"], "week", F.avg("count"), weeks).fillna(0.0).orderBy("tag")


def activity_tables(hashtags: DataFrame, cashtags: DataFrame, weekly: DataFrame) -> dict[str, DataFrame]:
    """Top hashtags, cashtag shares, the trend of the top tags and the weekly heat map."""
    return {
        "top_hashtags": _top_tags(hashtags, 20),
        "top_cashtag_shares": rk.share_of_total(_top_tags(cashtags, 10), "count"),
        "hashtag_trend": trend_of_top_tags(hashtags),
        "weekly_hashtags": weekly_heat_map(weekly),
    }


def overview_tables(features: DataFrame) -> dict[str, DataFrame]:
    """Size, dates, tags, splits, value distributions and volumes of a feature table."""
    volume = counts.totals_by(features, "tag_type", "tag")
    labelled = volume.withColumn("label", tag_label(F.col("tag_type"), F.col("tag")))
    ready = features.where("modeling_ready")
    return {
        "shape": counts.shape(features),
        "date_range": counts.date_range(features),
        "tags_by_type": counts.distinct_tags_by_type(features),
        "first_rows": canonical_order(features).limit(5),
        "ready_rows_by_split": counts.value_counts(ready, "split", SPLIT_ORDER),
        "rows_by_type": counts.value_counts(features, "tag_type"),
        "count_histogram": buckets.histogram(buckets.clip_at_quantile(features, "count"), "count", 30),
        "target_histogram": buckets.histogram(
            buckets.clip_at_quantile(features, "target_next_count"), "target_next_count", 30
        ),
        "top_volume": rk.top_k_reversed(labelled, 15, "count", ["tag_type", "tag"]),
    }


def comparison_tables(metrics: dict[str, DataFrame], times: DataFrame | None = None) -> dict[str, DataFrame]:
    """Metrics of several sources together, pivoted, with the winners and the training times."""
    together = staged(fc.combined_metrics(metrics), "all-metrics")
    pivot = reshape.pivot_values(
        together.where(F.col("split").isin(*fc.SCORED_SPLITS)), ["model"], "split", F.max("sMAPE"), ["validation", "test"]
    )
    best = fc.best_learned(together)
    tables = {
        "all_metrics": together.orderBy("split", "sMAPE", "MAE", "model"),
        "test_smape": together.where("split = 'test'").orderBy("sMAPE", "model"),
        "validation_vs_test": pivot.orderBy("test", "model"),
        "best_learned": fc.metrics_of_best(together, best),
        "test_winner": fc.test_winner(together),
    }
    if times is not None:
        seconds = times.select("model", "train_seconds")
        tables["training_times"] = seconds.orderBy("train_seconds", "model")
        tables["accuracy_vs_time"] = fc.accuracy_vs_time(together, seconds)
    return tables


def type_tables(by_type: DataFrame, models: list[str]) -> dict[str, DataFrame]:
    """Test sMAPE by tag type, one column per model."""
    test = by_type.where("split = 'test'")
    return {"type_smape": reshape.pivot_values(test, ["tag_type"], "model", F.max("sMAPE"), models)}


def tag_tables(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> dict[str, DataFrame]:
    """The hardest tags of two models, and where the second gains and loses most."""
    keys = ["tag_type", "tag"]
    gap = fc.compare_errors(left, right, *names)
    measure = f"{names[1]}_minus_{names[0]}"
    return {
        f"hardest_tags_{names[0]}": rk.top_k_reversed(left, 15, "sMAPE", keys),
        f"hardest_tags_{names[1]}": rk.top_k_reversed(right, 15, "sMAPE", keys),
        "tag_comparison": gap,
        "tag_changes": rk.extremes(gap, 10, measure, keys, ("regression", "improvement")),
    }


def example_series(predictions: DataFrame) -> DataFrame:
    """Actual and predicted counts of one representative tag per type, all models."""
    chosen = fc.representative_tags(predictions)
    rows = rk.membership(predictions, chosen, ["tag_type", "tag"])
    return rows.select("tag_type", "tag", "model", "date", fc.TARGET, "prediction").orderBy(
        "tag_type", "tag", "model", "date"
    )


def error_tables(predictions: DataFrame) -> dict[str, DataFrame]:
    """Residuals, buckets, heat map and worst misses of one model."""
    evaluated = staged(dg.evaluation_rows(predictions), "evaluated")
    bucketed = staged(
        buckets.quantile_buckets(evaluated, "actual").where("bucket is not null"), "actual-buckets"
    )
    return {
        "evaluated": evaluated,
        "axis_limit": dg.axis_limit(evaluated),
        "heat_map": dg.error_heat_map(evaluated),
        "heat_map_ticks": reshape.evenly_spaced_dates(evaluated),
        "error_by_bucket": dg.error_by_bucket(evaluated),
        "error_box_plot": buckets.box_plot(bucketed, "row_smape", ["bucket"], groups=4),
        "residual_histogram": buckets.histogram(evaluated, "residual", 35),
        "residual_summary": dg.residual_summary(evaluated),
        "worst_misses": dg.worst_misses(evaluated),
    }


def systems_summary(summaries: dict[str, DataFrame]) -> DataFrame:
    """One flat row per run summary; what a summary lacks is null."""
    fields = {
        "feature_file": "features",
        "gpu_requested": "gpu_requested",
        "device_used": "device_used",
        "epochs": "model_params.epochs",
        "batch_size": "model_params.batch_size",
        "num_workers": "num_workers",
        "total_training_seconds": "total_training_seconds",
    }
    types = {
        "gpu_requested": "boolean",
        "epochs": "long",
        "batch_size": "long",
        "num_workers": "long",
        "total_training_seconds": "double",
    }
    flat = []
    for run, summary in summaries.items():
        if "model_training_seconds" in summary.columns and "total_training_seconds" not in summary.columns:
            total = reshape.map_total(seconds_map(summary))
            summary = summary.withColumn("total_training_seconds", total)
        flat.append(reshape.flatten_summary(summary, fields, types).withColumn("run", F.lit(run)))
    return concat_all(flat).select("run", *fields)


def seconds_map(summary: DataFrame) -> Column:
    """Fit seconds as a map; a summary read back from JSON holds them as a struct."""
    column = F.col("model_training_seconds")
    return F.from_json(F.to_json(column), "map<string,double>")


def sentiment_tables(table: DataFrame) -> dict[str, DataFrame]:
    """Summary and coverage of optional sentiment columns."""
    names = reshape.columns_like(table, "sentiment", "positive", "negative").columns
    tables = {"shape": counts.shape(table)}
    if names:
        tables["describe"] = describe_columns(table, names).orderBy("measure")
    if "sentiment_tweet_count" in names:
        tables["coverage"] = counts.positive_share(table, "sentiment_tweet_count")
    return tables
