"""Baseline forecasts, error tables and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions.metrics import error_metrics
from tagloom.operators.panel import concat_all
from tagloom.operators.ranking import best_per_group, top_k
from tagloom.sources.tables import TARGET

# Baseline name and the feature it repeats.
BASELINES = {
    "baseline_last_value": "count",
    "baseline_rolling_mean_3": "rolling_mean_3",
    "baseline_rolling_mean_7": "rolling_mean_7",
    "baseline_lag_7": "count_lag_7",
}
OFFICIAL_BASELINE = "baseline_last_value"
SCORED_SPLITS = ("validation", "test")
PREDICTION_COLUMNS = ("date", "tag", "tag_type", TARGET, "split", "model", "prediction")
METRIC_COLUMNS = ("split", "model", "rows", "MAE", "RMSE", "sMAPE")


def baseline_forecasts(modeling: DataFrame) -> DataFrame:
    """One prediction column per baseline."""
    return modeling.select(
        "date", "tag", "tag_type", "count", TARGET, "split",
        *[F.col(feature).cast("double").alias(name) for name, feature in BASELINES.items()],
    )


def long_forecasts(wide: DataFrame, names: Sequence[str] = tuple(BASELINES), label: str = "baseline") -> DataFrame:
    """One row per baseline instead of one column."""
    ids = ["date", "tag", "tag_type", TARGET, "split"]
    return wide.select(*ids, *names).unpivot(ids, list(names), label, "prediction")


def scored(predictions: DataFrame, splits: Sequence[str] = SCORED_SPLITS) -> DataFrame:
    return predictions.where(F.col("split").isin(*splits))


def _metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(*error_metrics(TARGET, "prediction"))


def overall_metrics(predictions: DataFrame, model: str = "model") -> DataFrame:
    return _metrics(scored(predictions), "split", model)


def metrics_by_tag(predictions: DataFrame, chosen: str, model: str = "model") -> DataFrame:
    """Test metrics of one model per tag."""
    rows = predictions.where((F.col("split") == "test") & (F.col(model) == chosen))
    return _metrics(rows, "tag_type", "tag", model)


def metrics_by_type(predictions: DataFrame, model: str = "model") -> DataFrame:
    return _metrics(scored(predictions), "split", "tag_type", model)


def all_metrics(predictions: DataFrame, model: str = "model") -> DataFrame:
    """Overall, per-type and per-tag metrics from one pass over the predictions.

    ``level`` tells them apart.
    """
    keys = ["split", "tag_type", "tag", model]
    sets = [["split", model], ["split", "tag_type", model], keys]
    columns = {k: F.col(k) for k in keys}
    grouped = scored(predictions).groupingSets(
        [[columns[k] for k in chosen] for chosen in sets], *columns.values()
    )
    level = (
        F.when(F.grouping("tag_type") == 1, "overall")
        .when(F.grouping("tag") == 1, "by_type")
        .otherwise("by_tag")
    )
    return grouped.agg(level.alias("level"), *error_metrics(TARGET, "prediction")).select(
        "level", *keys, "rows", "MAE", "RMSE", "sMAPE"
    )


def sorted_overall(metrics: DataFrame, model: str = "model") -> DataFrame:
    return metrics.orderBy("split", "MAE", "sMAPE", model)


def sorted_by_tag(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("MAE"), F.desc("sMAPE"), "tag_type", "tag")


def sorted_by_type(metrics: DataFrame, model: str = "model") -> DataFrame:
    return metrics.orderBy("split", "tag_type", "sMAPE", "MAE", model)


def official_predictions(wide: DataFrame, baseline: str = OFFICIAL_BASELINE) -> DataFrame:
    """The official baseline in the shape of model predictions."""
    return (
        scored(wide)
        .withColumnsRenamed({baseline: "prediction"})
        .withColumn("model", F.lit(baseline))
        .select(*PREDICTION_COLUMNS)
    )


def add_official_baseline(learned: DataFrame, wide: DataFrame) -> DataFrame:
    """Learned predictions and the official baseline together."""
    return learned.select(*PREDICTION_COLUMNS).unionByName(official_predictions(wide))


def add_baseline_metrics(learned: DataFrame, baselines: DataFrame) -> DataFrame:
    official = baselines.withColumnsRenamed({"baseline": "model"}).where(
        F.col("model") == OFFICIAL_BASELINE
    )
    return learned.select(*METRIC_COLUMNS).unionByName(official.select(*METRIC_COLUMNS))


def combined_metrics(sources: dict[str, DataFrame]) -> DataFrame:
    """Metric tables of several sources under one schema, labelled in ``source``."""
    frames = [
        df.withColumnsRenamed({} if "model" in df.columns else {"baseline": "model"})
        .withColumn("source", F.lit(name))
        for name, df in sources.items()
    ]
    together = concat_all(frames)
    return together.withColumn("model", F.coalesce(F.col("model").cast("string"), F.lit("unknown")))


def best_model(metrics: DataFrame, split: str = "validation", exclude: Sequence[str] = ()) -> DataFrame:
    """The model with the lowest sMAPE, then MAE, on one split."""
    rows = metrics.where((F.col("split") == split) & ~F.col("model").isin(*exclude))
    return top_k(rows, 1, ["sMAPE", "MAE", "model"])


def best_learned(metrics: DataFrame) -> DataFrame:
    """Chosen on validation; the test split is only reported."""
    return best_model(metrics, "validation", list(BASELINES))


def best_test_reference(metrics: DataFrame) -> DataFrame:
    """The best learned model on test, the official baseline left out."""
    return best_model(metrics, "test", [OFFICIAL_BASELINE])


def metrics_of_best(metrics: DataFrame, best: DataFrame) -> DataFrame:
    """All rows of the chosen model; ``best`` is one row, so it is broadcast."""
    return metrics.join(F.broadcast(best.select("model")), "model", "left_semi").select(*metrics.columns)


def test_winner(metrics: DataFrame) -> DataFrame:
    return top_k(metrics.where("split = 'test'"), 1, ["sMAPE", "model"])


def best_per_split(metrics: DataFrame) -> DataFrame:
    return best_per_group(metrics.select(*METRIC_COLUMNS), ["split"], ["sMAPE", "MAE", "model"])


def replace_run(comparison: DataFrame, rows: DataFrame, run_label: str) -> DataFrame:
    """Rows of other runs plus the new rows of this run, sorted."""
    others = comparison.where(F.col("run_label") != run_label)
    labelled = rows.select(*METRIC_COLUMNS).withColumn("run_label", F.lit(run_label))
    return others.unionByName(labelled).orderBy("run_label", "split", "sMAPE", "MAE", "model")


def compare_errors(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, metric: str = "sMAPE"
) -> DataFrame:
    """Per-tag metric of two models side by side and its difference (right - left)."""
    keys = ["tag_type", "tag"]
    a = left.select(*keys, F.col(metric).alias(f"{left_name}_{metric}"))
    b = right.select(*keys, F.col(metric).alias(f"{right_name}_{metric}"))
    gap = F.col(f"{right_name}_{metric}") - F.col(f"{left_name}_{metric}")
    return a.join(b, keys).withColumn(f"{right_name}_minus_{left_name}", gap)


def accuracy_vs_time(metrics: DataFrame, times: DataFrame) -> DataFrame:
    """Test sMAPE beside the training seconds of each model, best first."""
    test = metrics.where("split = 'test'").select("model", "sMAPE")
    return test.join(times, "model").orderBy("sMAPE", "model")


def series_of(predictions: DataFrame, tag_type: str, tag: str, model: str) -> DataFrame:
    """Actual and predicted counts of one tag and model over time."""
    chosen = (F.col("tag_type") == tag_type) & (F.col("tag") == tag) & (F.col("model") == model)
    return predictions.where(chosen).select("date", TARGET, "prediction").orderBy("date")


def representative_tags(predictions: DataFrame) -> DataFrame:
    """The tag of each type with the largest summed target."""
    totals = predictions.groupBy("tag_type", "tag").agg(F.sum(TARGET).alias("volume"))
    ranked = totals.withColumn("_down", -F.col("volume"))
    return best_per_group(ranked, ["tag_type"], ["_down", "tag"]).drop("_down")


def running_best(history: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Flag the epochs that improve strictly on every earlier one.

    One row per epoch and run, so the window is small.
    """
    before = W.partitionBy(*run, F.lit(0)).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    best_before = F.min("validation_sMAPE").over(before)
    improved = best_before.isNull() | (F.col("validation_sMAPE") < best_before)
    return history.withColumn("best_before", best_before).withColumn("improved", improved)


def best_epoch(history: DataFrame) -> DataFrame:
    return top_k(history, 1, ["validation_sMAPE", "validation_MAE", "epoch"])


def learning_curve(history: DataFrame) -> DataFrame:
    """Loss, validation sMAPE and elapsed seconds by epoch; missing seconds are null."""
    if "elapsed_seconds" not in history.columns:
        history = history.withColumn("elapsed_seconds", F.lit(None).cast("double"))
    return history.select("epoch", "train_loss", "validation_sMAPE", "elapsed_seconds").orderBy("epoch")
