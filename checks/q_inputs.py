"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from checks.sql import JSON_STEPS, rounded, upto
from tagloom.functions import arithmetic as ar
from tagloom.functions.text import tag_label, whitespace_tokens
from tagloom.operators import clean, counts, forecasts as fc, reshape
from tagloom.operators.panel import concat_all
from tagloom.plans.forecasting import run_summary
from tagloom.session import REBASE_CONF, stage_path, staged
from tagloom.sinks import writers
from tagloom.sources import tables as src
from tagloom.sources import tweets as tw

OVERALL = 'SELECT split, model, "rows", ' + rounded("MAE", "RMSE", "sMAPE") + " FROM overall"


# ---- sources

@query("src_01_read_json_tweets", f"SELECT event_id, js ->> '$.entities.hashtags[0].text' AS first_tag FROM (SELECT event_id, CAST(js AS JSON) AS js FROM ({upto('json_tweets', 'SELECT event_id, js FROM json_tweets')}))")
def read_json(spark, sf):
    path = stage_path(spark, "json-lines")
    lines = t.json_tweets(spark, sf)
    body = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(","), F.expr("substr(json, 2)"))
    blank = lines.select(F.explode(F.array(body, F.lit("  "))).alias("value"))
    blank.write.text(path)
    return tw.read_tweets_json(spark, path).select(
        F.get_json_object("json", "$.event_id").cast("long").alias("event_id"),
        F.get_json_object("json", "$.entities.hashtags[0].text").alias("first_tag"),
    )


@query("src_02_read_csv_tweets", upto("tweets", "SELECT TRY_CAST(substr(created_at, 1, 10) AS DATE) AS date, text, count(*) AS copies FROM tweets GROUP BY 1, 2"))
def read_csv(spark, sf):
    path = stage_path(spark, "csv")
    t.tweets(spark, sf).select("created_at", "text").write.option("header", True).option("escape", '"').csv(path)
    rows = tw.read_tweets_csv(spark, path)
    dated = rows.select(F.col("created_at").try_cast("date").alias("date"), "text")
    return dated.groupBy("date", "text").agg(F.count(F.lit(1)).alias("copies"))


# Texts with line breaks and quotes, cut where a word ends.
_BROKEN = """CASE WHEN text IS NULL THEN 'no text' ELSE replace(replace(text, ' and ', concat(' and', chr(10))), ' near ', ' "near", ') END"""


@query("src_02_line_breaks_in_quotes", upto("tweets", f"SELECT text, count(*) AS copies, CAST(0 AS BIGINT) AS corrupt FROM (SELECT {_BROKEN} AS text FROM tweets) GROUP BY 1"))
def read_broken_lines(spark, sf):
    """Large files are read by many tasks, though records go over lines."""
    path = stage_path(spark, "csv-lines")
    tweets = t.tweets(spark, sf).selectExpr("created_at", f"{_BROKEN} AS text").coalesce(1)
    tweets.write.option("header", True).option("escape", '"').csv(path)
    rows = tw.read_tweets_csv(spark, path)
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.count("_corrupt").alias("corrupt"))


@query("src_03_read_text_lines", "SELECT url AS value FROM pages")
def read_lines(spark, sf):
    path = stage_path(spark, "urls")
    t.table(spark, sf, "pages").select("url").write.text(path)
    return tw.read_tokens(spark, path)


@query("src_04_read_daily_counts", upto("daily_c", "SELECT date, tag, 'cashtag' AS tag_type, count FROM daily_c"))
def read_daily(spark, sf):
    stored = t.daily(spark, sf, "cashtags").withColumn("extra", F.lit("not read"))
    path = stage_path(spark, "daily")
    writers.write_table(stored, path)
    return src.read_daily_counts(spark, path, "cashtag")


@query("src_05_load_modeling_frame", upto("modeling", "SELECT date, tag, tag_type, split, count, target_next_count FROM modeling"))
def load_modeling(spark, sf):
    path = stage_path(spark, "features")
    writers.write_table(t.features(spark, sf), path)
    return src.load_modeling_frame(spark, path).select("date", "tag", "tag_type", "split", "count", "target_next_count")


@query("src_06_read_optional_artifacts", upto("daily_h", "SELECT 'csv' AS format, count(*) AS found, CAST(sum(count) AS BIGINT) AS total FROM daily_h UNION ALL SELECT 'json', count(*), CAST(sum(count) AS BIGINT) FROM daily_h UNION ALL SELECT 'parquet', count(*), CAST(sum(count) AS BIGINT) FROM daily_h"))
def read_optional(spark, sf):
    base = stage_path(spark, "artifacts")
    rows = staged(t.daily(spark, sf), "daily")
    rows.write.option("header", True).csv(f"{base}/csv")
    rows.write.json(f"{base}/json")
    rows.write.parquet(f"{base}/parquet")
    read = {fmt: src.read_if_exists(spark, f"{base}/{fmt}", fmt) for fmt in ("csv", "json", "parquet")}
    read["absent"] = src.read_if_exists(spark, f"{base}/absent", "csv")
    return concat_all(
        [
            df.agg(F.count(F.lit(1)).alias("found"), F.sum("count").cast("long").alias("total")).withColumn("format", F.lit(fmt))
            for fmt, df in read.items()
            if df is not None
        ]
    )


@query("src_07_first_existing_path", upto("daily_c", "SELECT tag, CAST(sum(count) AS BIGINT) AS total FROM daily_c GROUP BY tag"))
def first_existing(spark, sf):
    base = stage_path(spark, "candidates")
    t.daily(spark, sf, "cashtags").write.parquet(f"{base}/second")
    found = src.read_first_existing(spark, [f"{base}/first", f"{base}/second"], "parquet")
    return counts.totals_by(found, "tag", name="total")


# ---- sinks

@query("snk_01_write_token_lists", JSON_STEPS + "SELECT 'combined' AS list, token, count(*) AS n FROM raw_tokens GROUP BY token UNION ALL SELECT kind || 's', token, count(*) FROM raw_tokens GROUP BY kind, token")
def write_lists(spark, sf):
    rows = staged(t.tokens(spark, sf), "tokens")
    paths = writers.write_token_lists(rows, stage_path(spark, "lists"))
    frames = [tw.read_tokens(spark, path).withColumn("list", F.lit(name)) for name, path in paths.items()]
    return concat_all(frames).groupBy("list", F.col("value").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("snk_02_save_sorted_pairs", r"SELECT concat('(', word, ',', CAST(count(*) AS VARCHAR), ')') AS value FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def save_pairs(spark, sf):
    path = stage_path(spark, "pairs")
    words = t.table(spark, sf, "documents").select(F.explode(whitespace_tokens(F.col("text"))).alias("word"))
    writers.write_pairs(counts.word_count(words, "word"), path)
    return tw.read_tokens(spark, path)


@query("snk_03_overwrite_parquet", upto("weekly_h", "SELECT week, tag, count FROM weekly_h"))
def overwrite(spark, sf):
    path = stage_path(spark, "weekly")
    weekly = counts.weekly_counts(t.cleaned(spark, sf))
    writers.write_table(weekly, path)
    writers.write_table(weekly, path)
    return spark.read.parquet(path).select(F.col("week").cast("date").alias("week"), "tag", "count")


@query("snk_03_cleaned_tweets_by_date", upto("cleaned", r"SELECT date, text, array_to_string(regexp_extract_all(lower(text), '#[\p{L}\p{N}_]+'), ' ') AS hashtags, array_to_string(regexp_extract_all(upper(text), '[$][A-Z]{1,5}'), ' ') AS cashtags FROM cleaned"))
def cleaned_by_date(spark, sf):
    path = stage_path(spark, "cleaned")
    writers.write_by_date(t.cleaned(spark, sf), path)
    rows = spark.read.parquet(path)
    return rows.select("date", "text", F.array_join("hashtags", " ").alias("hashtags"), F.array_join("cashtags", " ").alias("cashtags"))


@query("snk_04_parquet_old_dates", "SELECT event_id, CAST(ts AS DATE) - CAST(200000 AS INTEGER) AS date FROM events")
def old_dates(spark, sf):
    path = stage_path(spark, "old-dates")
    before = {key: spark.conf.get(key, None) for key in REBASE_CONF}
    for key, value in REBASE_CONF.items():
        spark.conf.set(key, value)
    try:
        rows = t.table(spark, sf, "events").select("event_id", F.date_sub(F.col("ts").cast("date"), 200000).alias("date"))
        writers.write_table(rows, path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.parquet(path)


@query("snk_05_write_predictions", upto("baselines", "SELECT date, tag, tag_type, count, target_next_count, split, baseline_last_value, " + rounded("baseline_rolling_mean_3", "baseline_rolling_mean_7") + ", baseline_lag_7 FROM baselines"))
def write_predictions(spark, sf):
    path = stage_path(spark, "predictions")
    writers.write_table(t.baselines(spark, sf), path)
    return t.rounded(spark.read.parquet(path), "baseline_rolling_mean_3", "baseline_rolling_mean_7")


@query("snk_06_metric_csv_by_run", upto("overall", OVERALL.replace("SELECT", "SELECT 'first' AS run_label,") + " UNION ALL " + OVERALL.replace("SELECT", "SELECT 'second' AS run_label,")))
def metric_csv(spark, sf):
    path = stage_path(spark, "metrics-csv")
    metrics = staged(fc.overall_metrics(t.predictions(spark, sf)), "metrics")
    for label in ("first", "second", "first"):
        writers.write_run_csv(metrics, path, label)
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    typed = rows.select("run_label", "split", "model", F.col("rows").cast("long"), *t.METRICS)
    return t.rounded(typed, *t.METRICS)


def _summary(spark, sf):
    metrics = staged(fc.overall_metrics(t.predictions(spark, sf)), "metrics")
    times = metrics.where("split = 'test'").select("model", F.col("rows").cast("double").alias("train_seconds"))
    models = sorted(set(fc.BASELINES) - {fc.OFFICIAL_BASELINE})
    return run_summary(metrics, times, "checked", "features", models)


@query("snk_07_run_summary_json", upto("overall", """SELECT 'checked' AS run_label, best.model AS best_learned_model,
 round(v."sMAPE", 6) + 0 AS best_validation, round(e."sMAPE", 6) + 0 AS best_test, round(bv."MAE", 6) + 0 AS baseline_validation_mae,
 round(bt."RMSE", 6) + 0 AS baseline_test_rmse, 3 AS compared, CAST((SELECT sum("rows") FROM overall WHERE split = 'test') AS DOUBLE) AS total_seconds
 FROM (SELECT model FROM overall WHERE split = 'validation' AND model <> 'baseline_last_value' ORDER BY "sMAPE", "MAE", model LIMIT 1) best
 JOIN overall v ON v.model = best.model AND v.split = 'validation' JOIN overall e ON e.model = best.model AND e.split = 'test'
 JOIN overall bv ON bv.model = 'baseline_last_value' AND bv.split = 'validation' JOIN overall bt ON bt.model = 'baseline_last_value' AND bt.split = 'test'"""))
def summary_json(spark, sf):
    path = stage_path(spark, "summary")
    writers.write_summary(_summary(spark, sf), path)
    seconds = "map<string,double>"
    metric = "struct<split: string, model: string, rows: bigint, MAE: double, RMSE: double, sMAPE: double>"
    schema = (
        "run_label string, features string, include_sentiment boolean, official_baseline string, best_learned_model string, "
        f"best_learned_validation_metrics {metric}, best_learned_test_metrics {metric}, baseline_validation_metrics {metric}, "
        f"baseline_test_metrics {metric}, models_compared array<string>, model_training_seconds {seconds}"
    )
    rows = spark.read.schema(schema).json(path)
    flat = rows.select(
        "run_label",
        "best_learned_model",
        F.col("best_learned_validation_metrics.sMAPE").alias("best_validation"),
        F.col("best_learned_test_metrics.sMAPE").alias("best_test"),
        F.col("baseline_validation_metrics.MAE").alias("baseline_validation_mae"),
        F.col("baseline_test_metrics.RMSE").alias("baseline_test_rmse"),
        F.size("models_compared").alias("compared"),
        reshape.map_total(F.col("model_training_seconds")).alias("total_seconds"),
    )
    return t.rounded(flat, "best_validation", "best_test", "baseline_validation_mae", "baseline_test_rmse")


@query("snk_08_replace_run_in_comparison", upto("overall", OVERALL.replace("SELECT", "SELECT 'old' AS run_label,") + " WHERE model = 'baseline_lag_7' UNION ALL " + OVERALL.replace("SELECT", "SELECT 'new' AS run_label,")))
def replace_run(spark, sf):
    path = stage_path(spark, "comparison")
    metrics = staged(fc.overall_metrics(t.predictions(spark, sf)), "metrics")
    labelled = lambda df, label: df.withColumn("run_label", F.lit(label))
    stale = labelled(metrics.withColumn("MAE", F.lit(-1.0)), "new")
    writers.write_comparison(labelled(metrics.where("model = 'baseline_lag_7'"), "old").unionByName(stale), path)
    writers.write_comparison(labelled(metrics, "new"), path)
    kept = spark.read.parquet(path)
    merged = fc.replace_run(kept, metrics, "new")
    return t.rounded(merged.select("run_label", *fc.METRIC_COLUMNS), *t.METRICS)


@query("snk_09_row_count", "SELECT count(*) AS \"rows\", 3 AS \"columns\" FROM events")
def row_count(spark, sf):
    return counts.shape(t.tweets(spark, sf)).withColumn("columns", F.col("columns").cast("int"))


# ---- projections

@query("prj_01_derived_columns", upto("cleaned", r"SELECT text, len(regexp_extract_all(lower(text), '#[\p{L}\p{N}_]+')) AS hashtags, len(regexp_extract_all(upper(text), '[$][A-Z]{1,5}')) AS cashtags, CAST(date_trunc('week', date) AS DATE) AS week FROM cleaned"))
def derived_columns(spark, sf):
    rows = clean.add_tags(clean.distinct_texts(t.tweets(spark, sf)))
    return rows.select("text", F.size("hashtags").cast("long").alias("hashtags"), F.size("cashtags").cast("long").alias("cashtags"), F.col("week").cast("date").alias("week"))


@query("prj_02_select_columns", upto("cleaned", "SELECT date, text FROM cleaned"))
def select_columns(spark, sf):
    return t.cleaned(spark, sf).select("date", "text")


@query("prj_03_rename_columns", upto("baselines", "SELECT date, tag, tag_type, target_next_count AS actual, baseline_last_value AS prediction FROM baselines"))
def rename_columns(spark, sf):
    renamed = reshape.rename(t.baselines(spark, sf), {"target_next_count": "actual", "baseline_last_value": "prediction"})
    return renamed.select("date", "tag", "tag_type", "actual", "prediction")


@query("prj_04_canonical_names", upto("baselines", "SELECT tag, date, target_next_count AS actual, baseline_lag_7 AS prediction, count AS y_pred FROM baselines"))
def canonical_names(spark, sf):
    odd = t.baselines(spark, sf).select("tag", "date", F.col("target_next_count").alias("y_true"), F.col("baseline_lag_7").alias("prediction"), F.col("count").alias("y_pred"))
    return reshape.canonical_names(odd)


@query("prj_05_add_missing_columns", upto("baselines", "SELECT tag, CAST(NULL AS DATE) AS date, 'unknown' AS tag_type, 'unknown' AS split, count FROM baselines"))
def add_missing(spark, sf):
    return reshape.add_missing(t.baselines(spark, sf).select("tag", "count"))


@query("prj_06_constant_columns", upto("daily_h", "SELECT date, tag, count, 'derived' AS source, 'count_only' AS run_label FROM daily_h"))
def constant_columns(spark, sf):
    return reshape.with_constants(t.daily(spark, sf), source="derived", run_label="count_only")


@query("prj_07_baseline_columns", upto("baselines", "SELECT date, tag, tag_type, split, count, target_next_count, baseline_last_value, " + rounded("baseline_rolling_mean_3", "baseline_rolling_mean_7") + ", baseline_lag_7 FROM baselines"))
def baseline_columns(spark, sf):
    return t.rounded(t.baselines(spark, sf), "baseline_rolling_mean_3", "baseline_rolling_mean_7")


@query("prj_08_columns_by_name_part", upto("features", "SELECT date, tag, tag_type, " + rounded("rolling_mean_3", "rolling_mean_7", "rolling_std_3", "rolling_std_7", "anomaly_z_ready_7", "anomaly_trailing_mean_7", "anomaly_trailing_std_7", "anomaly_deviation_7") + " FROM features"))
def columns_by_part(spark, sf):
    picked = reshape.columns_like(t.features(spark, sf), "rolling", "anomaly", keep=("date", "tag", "tag_type"))
    return t.rounded(picked, *[c for c in picked.columns if c not in ("date", "tag", "tag_type")])


@query("prj_09_tag_label", upto("summary", "SELECT tag_type || ': ' || tag AS label, total_count FROM summary"))
def tag_labels(spark, sf):
    rows = counts.tag_summary(t.lazy_counts(spark, sf))
    return rows.select(tag_label(F.col("tag_type"), F.col("tag")).alias("label"), "total_count")


@query("prj_10_flatten_summary", upto("overall", """SELECT 'checked' AS run, 'features' AS feature_file, CAST(NULL AS STRING) AS device_used, CAST(NULL AS INTEGER) AS epochs,
 round("MAE", 6) + 0 AS baseline_test_mae FROM overall WHERE split = 'test' AND model = 'baseline_last_value'"""))
def flatten_summary(spark, sf):
    fields = {
        "run": "run_label",
        "feature_file": "features",
        "device_used": "device_used",
        "epochs": "model_params.epochs",
        "baseline_test_mae": "baseline_test_metrics.MAE",
    }
    flat = reshape.flatten_summary(_summary(spark, sf), fields, {"epochs": "int"})
    return t.rounded(flat, "baseline_test_mae")


# ---- filters

@query("flt_01_drop_null_text", upto("tweets", "SELECT event_id, text FROM tweets WHERE text IS NOT NULL"))
def drop_null_text(spark, sf):
    return clean.drop_null_text(t.tweets(spark, sf)).select("event_id", "text")


@query("flt_02_drop_blank_lines", r"SELECT doc_id, line AS value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def drop_blank_lines(spark, sf):
    lines = t.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("value"))
    return tw.drop_blank_lines(lines)


@query("flt_03_drop_empty_tokens", "SELECT event_id, event_type AS token FROM events WHERE event_type <> 'error'")
def drop_empty(spark, sf):
    token = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    rows = t.table(spark, sf, "events").select("event_id", F.explode(F.array(token, F.lit(None))).alias("token"))
    return clean.drop_empty(rows, "token")


@query("flt_04_modeling_ready_rows", upto("modeling", "SELECT tag_type, tag, date FROM modeling"))
def ready_rows(spark, sf):
    return t.features(spark, sf).where("modeling_ready").select("tag_type", "tag", "date")


@query("flt_05_date_range", upto("daily_h", "SELECT date, tag, count FROM daily_h WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"))
def date_range(spark, sf):
    return clean.between_dates(t.daily(spark, sf), "2024-01-05", "2024-01-20")


@query("flt_06_group_threshold", upto("summary", "SELECT tag_type, tag, total_count, observed_days FROM summary WHERE observed_days >= 20"))
def group_threshold(spark, sf):
    return clean.group_threshold(counts.tag_summary(t.lazy_counts(spark, sf)), "observed_days >= 20")


@query("flt_07_split_and_model_membership", upto("long", "SELECT date, tag, model, split, round(prediction, 6) + 0 AS prediction FROM long WHERE split IN ('validation', 'test') AND model IN ('baseline_last_value', 'baseline_lag_7')"))
def membership(spark, sf):
    rows = clean.keep_values(t.predictions(spark, sf), "split", ["validation", "test"])
    rows = clean.keep_values(rows, "model", ["baseline_last_value", "baseline_lag_7"])
    return t.rounded(rows.select("date", "tag", "model", "split", "prediction"), "prediction")


@query("flt_08_modeling_ready_flag", upto("features", "SELECT date, tag, tag_type, modeling_ready FROM features"))
def ready_flag(spark, sf):
    return t.features(spark, sf).select("date", "tag", "tag_type", "modeling_ready")


@query("flt_09_numeric_pairs", "SELECT event_id, CAST(value AS DOUBLE) AS actual, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS prediction FROM events WHERE value IS NOT NULL AND TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS DOUBLE) IS NOT NULL")
def numeric_pairs(spark, sf):
    k = F.get_json_object("props", "$.k")
    raw = t.table(spark, sf, "events").select(
        "event_id",
        F.col("value").cast("string").alias("actual"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(k).alias("prediction"),
    )
    return clean.numeric_pairs(raw)


@query("flt_10_infinities_to_null", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events")
def infinities(spark, sf):
    infinite = F.when(F.col("event_type") == "error", F.lit(float("-inf"))).otherwise(F.col("value"))
    return t.table(spark, sf, "events").select("event_id", ar.finite_or_null(infinite).alias("value"))
