"""Run a job: ``python -m tagloom JOB INPUT OUTPUT``, or the same through spark-submit.

Jobs and their inputs:

    corpus    JSON-lines tweets            -> token lists and sorted word counts
    counts    CSV tweets                   -> cleaned tweets, daily and weekly counts
    activity  output folder of ``counts``  -> tables behind the activity charts
    features  output folder of ``counts``  -> feature table
    forecast  feature table                -> baselines, models, error tables, run summary
    overview  feature table                -> size, splits and distributions
    errors    output folder of ``forecast``-> comparison and error tables
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.forecasts import best_learned, representative_tags
from tagloom.plans import corpus, feature_table, forecasting, reports, tag_counts
from tagloom.session import configure
from tagloom.sinks.writers import write_table

COUNT_TABLES = ("daily_hashtag_counts", "daily_cashtag_counts", "weekly_hashtag_counts")


def _count_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in COUNT_TABLES]


def _write_all(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}")


def run_corpus(spark: SparkSession, args: argparse.Namespace) -> None:
    result = corpus.run(spark, args.input, args.output)
    result.totals.show()
    print(f"{result.lines} lines, {result.unreadable} unreadable")


def run_counts(spark: SparkSession, args: argparse.Namespace) -> None:
    result = tag_counts.run(spark, args.input, args.output)
    for tag_type in feature_table.TAG_TYPES:
        result.top(10, tag_type).show(truncate=False)
    print(f"{result.rows} rows, {result.corrupt} corrupt")


def run_activity(spark: SparkSession, args: argparse.Namespace) -> None:
    hashtags, cashtags, weekly = _count_tables(spark, args.input)
    _write_all(reports.activity_tables(hashtags, cashtags, weekly), args.output)


def run_features(spark: SparkSession, args: argparse.Namespace) -> None:
    hashtags, cashtags, _ = _count_tables(spark, args.input)
    settings = feature_table.PanelSettings(
        args.start, args.end, args.top_n, args.min_days, args.train_dates, args.validation_dates
    )
    features, counted = feature_table.staged_features(feature_table.features_from_daily(hashtags, cashtags, settings), settings)
    write_table(feature_table.validate_counted(features, settings, counted, args.dates), args.output)


def run_forecast(spark: SparkSession, args: argparse.Namespace) -> None:
    result = forecasting.run(spark.read.parquet(args.input), args.run_label, features_path=args.input)
    forecasting.save(result, args.output)
    result.overall.show(truncate=False)


def run_overview(spark: SparkSession, args: argparse.Namespace) -> None:
    _write_all(reports.overview_tables(spark.read.parquet(args.input)), args.output)


def run_errors(spark: SparkSession, args: argparse.Namespace) -> None:
    csv = lambda name: (
        spark.read.options(header=True, inferSchema=True)
        .csv(f"{args.input}/{name}")
        .where(F.col("run_label") == args.run_label)
    )
    predictions = spark.read.parquet(f"{args.input}/model_predictions")
    overall, baselines = csv("model_metrics_overall"), csv("baseline_metrics_overall")
    learned = overall.where(~F.col("model").startswith("baseline_"))
    tables = reports.comparison_tables({"baseline": baselines, "learned": learned}, csv("training_times"))
    best = best_learned(overall).first()["model"]
    tables |= reports.error_tables(predictions.where(F.col("model") == best))
    tables["example_series"] = reports.example_series(predictions)
    tables["representative_tags"] = representative_tags(predictions)
    _write_all(tables, args.output)


JOBS = {
    "corpus": run_corpus,
    "counts": run_counts,
    "activity": run_activity,
    "features": run_features,
    "forecast": run_forecast,
    "overview": run_overview,
    "errors": run_errors,
}


def parser() -> argparse.ArgumentParser:
    defaults = feature_table.PanelSettings()
    p = argparse.ArgumentParser(prog="tagloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--run-label", default="count_only")
    p.add_argument("--start", default=defaults.start)
    p.add_argument("--end", default=defaults.end)
    p.add_argument("--top-n", type=int, default=defaults.top_n)
    p.add_argument("--min-days", type=int, default=defaults.min_observed_days)
    p.add_argument("--train-dates", type=int, default=defaults.train_dates)
    p.add_argument("--validation-dates", type=int, default=defaults.validation_dates)
    p.add_argument("--dates", type=int, help="observed dates that must be there")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    session = spark or configure(SparkSession.builder.appName(f"tagloom-{args.job}")).getOrCreate()
    JOBS[args.job](session, args)


if __name__ == "__main__":
    main()
