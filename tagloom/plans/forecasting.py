"""Feature table to baselines, learned models, error tables and run summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import forecasts as fc
from tagloom.operators.models import MODEL_CONFIGS, ModelConfig, fit_models, training_times
from tagloom.operators.quality import require_row_total
from tagloom.operators.reshape import rows_to_map
from tagloom.session import staged
from tagloom.sinks.writers import write_comparison, write_run_csv, write_summary, write_table
from tagloom.sources.tables import modeling_rows


@dataclass(frozen=True)
class ForecastRun:
    run_label: str
    baseline_predictions: DataFrame
    baseline_overall: DataFrame
    baseline_by_tag: DataFrame
    baseline_by_type: DataFrame
    predictions: DataFrame
    overall: DataFrame
    by_tag: DataFrame
    by_type: DataFrame
    times: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class MetricTables:
    """Error tables cut from one small table of all metrics."""

    metrics: DataFrame
    model: str

    def _level(self, level: str, *keys: str) -> DataFrame:
        rows = self.metrics.where(F.col("level") == level)
        return rows.select(*keys, self.model, "rows", "MAE", "RMSE", "sMAPE")

    def overall(self) -> DataFrame:
        return self._level("overall", "split")

    def by_type(self) -> DataFrame:
        return self._level("by_type", "split", "tag_type")

    def by_tag(self, chosen: str) -> DataFrame:
        """Test errors of one model per tag."""
        rows = self._level("by_tag", "split", "tag_type", "tag")
        return rows.where((F.col("split") == "test") & (F.col(self.model) == chosen)).drop("split")


def metric_tables(predictions: DataFrame, model: str = "model") -> MetricTables:
    """All levels of metrics from one pass over the predictions, written once."""
    return MetricTables(staged(fc.all_metrics(predictions, model), "metrics"), model)


def run_summary(
    metrics: DataFrame, times: DataFrame, run_label: str, features: str, models: Sequence[str]
) -> DataFrame:
    """One nested row: chosen model, its metrics, the baseline's, and the fit seconds.

    ``metrics`` has one row per model and split.
    """
    row = F.struct(*fc.METRIC_COLUMNS)

    def metric(model, split: str):
        return F.max_by(row, F.when((F.col("model") == model) & (F.col("split") == split), 1))

    best = fc.best_model(metrics, "validation", [fc.OFFICIAL_BASELINE]).select("model").scalar()
    seconds = rows_to_map(times, "model", "train_seconds").scalar()
    named = metrics.withColumn("_best", best)
    return named.agg(
        F.lit(run_label).alias("run_label"),
        F.lit(features).alias("features"),
        F.lit(False).alias("include_sentiment"),
        F.lit(fc.OFFICIAL_BASELINE).alias("official_baseline"),
        F.max("_best").alias("best_learned_model"),
        metric(F.col("_best"), "validation").alias("best_learned_validation_metrics"),
        metric(F.col("_best"), "test").alias("best_learned_test_metrics"),
        metric(F.lit(fc.OFFICIAL_BASELINE), "validation").alias("baseline_validation_metrics"),
        metric(F.lit(fc.OFFICIAL_BASELINE), "test").alias("baseline_test_metrics"),
        F.array(*[F.lit(m) for m in models]).alias("models_compared"),
    ).withColumn("model_training_seconds", seconds)


def run(
    features: DataFrame,
    run_label: str = "count_only",
    configs: Sequence[ModelConfig] = MODEL_CONFIGS,
    features_path: str = "",
) -> ForecastRun:
    """Baselines, model fits, comparison and summary over a stored feature table."""
    modeling = modeling_rows(features)
    wide = fc.baseline_forecasts(modeling)
    baselines = metric_tables(fc.long_forecasts(wide), "baseline")
    fitted = fit_models(modeling, configs)
    predictions = staged(fc.add_official_baseline(fitted.predictions, wide), "predictions")
    scored_rows = fc.scored(modeling).count()
    require_row_total(predictions, scored_rows * (len(configs) + 1), "predictions")
    metrics = metric_tables(predictions)
    overall = metrics.overall()
    learned = [c.name for c in configs]
    best = fc.best_learned(overall).first()["model"]
    times = training_times(
        features.sparkSession, fitted.seconds, run_label, modeling.where("split = 'train'").count()
    )
    return ForecastRun(
        run_label,
        wide,
        fc.sorted_overall(baselines.overall(), "baseline"),
        fc.sorted_by_tag(baselines.by_tag(fc.OFFICIAL_BASELINE)),
        baselines.by_type().orderBy("split", "tag_type", "MAE", "baseline"),
        predictions,
        fc.sorted_overall(overall),
        fc.sorted_by_tag(metrics.by_tag(best)),
        fc.sorted_by_type(metrics.by_type()),
        times,
        run_summary(overall, times, run_label, features_path, learned),
    )


def save(result: ForecastRun, folder: str) -> None:
    """Write every table of a run; the run label is a partition, not a file name."""
    write_table(result.baseline_predictions, f"{folder}/baseline_predictions")
    write_table(result.predictions, f"{folder}/model_predictions")
    tables = {
        "baseline_metrics_overall": result.baseline_overall,
        "baseline_metrics_by_tag": result.baseline_by_tag,
        "baseline_metrics_by_tag_type": result.baseline_by_type,
        "model_metrics_overall": result.overall,
        "model_metrics_by_tag": result.by_tag,
        "model_metrics_by_tag_type": result.by_type,
        "training_times": result.times,
    }
    for name, df in tables.items():
        write_run_csv(df, f"{folder}/{name}", result.run_label)
    write_summary(result.summary, f"{folder}/run_summary")
    labelled = result.overall.withColumn("run_label", F.lit(result.run_label))
    write_comparison(labelled, f"{folder}/run_comparison")
