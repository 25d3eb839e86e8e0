"""Joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from checks.sql import JSON_STEPS, rounded, upto
from tagloom.functions import metrics as mx
from tagloom.operators import buckets, corpus, counts, diagnostics as dg, forecasts as fc, panel, quantiles as qt
from tagloom.operators import ranking as rk
from tagloom.operators import reshape, scaling, splits
from tagloom.session import staged

METRICS = rounded("MAE", "RMSE", "sMAPE")
BY_TAG = f'tag_type, tag, model, "rows", {METRICS} FROM by_tag WHERE split = \'test\''


# ---- joins

@query("join_01_tag_date_grid", upto("spine", "SELECT tag_type, tag, date FROM selected CROSS JOIN spine"))
def grid(spark, sf):
    rows = t.counts(spark, sf)
    return panel.panel_grid(rows, t.selected(rows))


@query("join_02_counts_of_selected_tags", upto("selected", "SELECT c.date, c.tag, c.tag_type, c.count FROM counts c JOIN selected s ON c.tag_type = s.tag_type AND c.tag = s.tag"))
def selected_counts(spark, sf):
    rows = t.counts(spark, sf)
    return panel.counts_of(rows, t.selected(rows), t.SETTINGS.selected_rows).select("date", "tag", "tag_type", "count")


@query("join_03_zero_filled_panel", upto("panel", "SELECT date, tag, tag_type, count FROM panel"))
def zero_filled(spark, sf):
    return t.panel(spark, sf)


@query("join_03_zero_cells", upto("panel", "SELECT tag_type, count(*) AS cells, count(CASE WHEN count = 0 THEN 1 END) AS zero_cells FROM panel GROUP BY tag_type"))
def zero_cells(spark, sf):
    zero = F.count(F.when(F.col("count") == 0, 1))
    return t.panel(spark, sf).groupBy("tag_type").agg(F.count(F.lit(1)).alias("cells"), zero.alias("zero_cells"))


@query("join_04_date_to_split", upto("features", "SELECT date, tag, tag_type, split FROM features"))
def join_split(spark, sf):
    rows = staged(t.panel(spark, sf), "panel")
    calendar = splits.split_calendar(rows, t.TRAIN, t.VALIDATION)
    return splits.join_splits(rows, calendar).select("date", "tag", "tag_type", "split")


@query("join_05_two_models_by_tag", upto("by_tag", """SELECT a.tag_type, a.tag, round(a."sMAPE", 6) + 0 AS "last_sMAPE", round(b."sMAPE", 6) + 0 AS "mean_sMAPE", round(b."sMAPE" - a."sMAPE", 6) + 0 AS mean_minus_last
 FROM by_tag a JOIN by_tag b ON a.tag_type = b.tag_type AND a.tag = b.tag WHERE a.split = 'test' AND b.split = 'test' AND a.model = 'baseline_last_value' AND b.model = 'baseline_rolling_mean_7'"""))
def two_models(spark, sf):
    rows = t.stored_predictions(spark, sf)
    last = fc.metrics_by_tag(rows, "baseline_last_value")
    mean = fc.metrics_by_tag(rows, "baseline_rolling_mean_7")
    return t.rounded(fc.compare_errors(last, mean, "last", "mean"), "last_sMAPE", "mean_sMAPE", "mean_minus_last")


_TIMES = """(SELECT model, CAST(count(*) AS DOUBLE) AS train_seconds FROM long WHERE split = 'train' AND prediction > 5 GROUP BY model)"""


def _times(predictions):
    busy = predictions.where("split = 'train' and prediction > 5")
    return busy.groupBy("model").agg(F.count(F.lit(1)).cast("double").alias("train_seconds"))


@query("join_06_accuracy_and_time", upto("overall", f'SELECT model, round("sMAPE", 6) + 0 AS "sMAPE", train_seconds FROM overall JOIN {_TIMES} USING (model) WHERE split = \'test\''))
def accuracy_time(spark, sf):
    rows = t.stored_predictions(spark, sf)
    return t.rounded(fc.accuracy_vs_time(fc.overall_metrics(rows), _times(rows)), "sMAPE")


_TOP12 = "(SELECT tag_type, tag, sum(actual) AS volume FROM evaluated GROUP BY tag_type, tag ORDER BY volume DESC, tag_type, tag LIMIT 12)"


@query("join_07_rows_of_top_tags", upto("evaluated", f"SELECT e.tag_type, e.tag, e.date, e.actual, round(e.row_smape, 6) + 0 AS row_smape FROM evaluated e JOIN {_TOP12} p ON e.tag_type = p.tag_type AND e.tag = p.tag"))
def rows_of_top_tags(spark, sf):
    rows = t.evaluated(spark, sf)
    kept = rk.membership(rows, dg.top_volume_tags(rows), ["tag_type", "tag"])
    return t.rounded(kept.select("tag_type", "tag", "date", "actual", "row_smape"), "row_smape")


_TOP5 = "(SELECT tag, sum(count) AS total FROM daily_h GROUP BY tag ORDER BY total DESC, tag LIMIT 5)"


@query("join_08_membership_in_top_k", upto("daily_h", f"SELECT date, tag, count FROM daily_h WHERE tag IN (SELECT tag FROM {_TOP5})"))
def top_k_members(spark, sf):
    rows = staged(t.daily(spark, sf), "daily")
    top = rk.top_k(counts.totals_by(rows, "tag", name="total"), 5, [F.desc("total"), "tag"])
    return rk.membership(rows, top, ["tag"]).select("date", "tag", "count")


@query("join_09_rows_of_other_runs", upto("overall", f'SELECT model AS run_label, split, model, "rows", {METRICS} FROM overall WHERE model <> \'baseline_lag_7\''))
def other_runs(spark, sf):
    metrics = fc.overall_metrics(t.predictions(spark, sf)).withColumn("run_label", F.col("model"))
    none = metrics.where("false").select(*fc.METRIC_COLUMNS)
    kept = fc.replace_run(metrics.select("run_label", *fc.METRIC_COLUMNS), none, "baseline_lag_7")
    return t.rounded(kept, *t.METRICS)


# ---- counts

_SPACE = """SELECT CASE WHEN regexp_full_match(text, ' +') THEN [] ELSE string_split(regexp_replace(text, ' +$', ''), ' ') END AS words FROM documents"""


@query("agg_01_word_count", f"SELECT word, count(*) AS count FROM (SELECT unnest(words) AS word FROM ({_SPACE})) GROUP BY word")
def word_count(spark, sf):
    return counts.word_count(t.table(spark, sf, "documents"), "text")


@query("agg_01_word_count_conversations", f"SELECT word, count(*) AS count FROM (SELECT unnest(words) AS word FROM ({_SPACE.replace('documents', 'conversations')})) GROUP BY word")
def word_count_conversations(spark, sf):
    return counts.word_count(t.table(spark, sf, "conversations"), "text")


@query("agg_02_whitespace_word_count", r"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def whitespace_count(spark, sf):
    return counts.whitespace_word_count(t.table(spark, sf, "documents"), "text")


@query("agg_03_daily_hashtag_counts", upto("daily_h", "SELECT date, tag, count FROM daily_h"))
def daily_hashtags(spark, sf):
    return t.daily(spark, sf)


@query("agg_04_daily_cashtag_counts", upto("daily_c", "SELECT date, tag, count FROM daily_c"))
def daily_cashtags(spark, sf):
    return t.daily(spark, sf, "cashtags")


@query("agg_05_weekly_hashtag_counts", upto("weekly_h", "SELECT week, tag, count FROM weekly_h"))
def weekly_hashtags(spark, sf):
    rows = counts.weekly_counts(t.cleaned(spark, sf))
    return rows.withColumn("week", F.col("week").cast("date"))


@query("agg_05_weekly_from_daily_counts", upto("weekly_h", "SELECT week, tag, count FROM weekly_h"))
def weekly_rollup(spark, sf):
    rows = counts.weekly_from_daily(t.daily(spark, sf))
    return rows.withColumn("week", F.col("week").cast("date"))


@query("agg_05_weekly_cashtag_counts", upto("weekly_c", "SELECT week, tag, count FROM weekly_c"))
def weekly_cashtags(spark, sf):
    rows = counts.weekly_counts(t.cleaned(spark, sf), "cashtags")
    return rows.withColumn("week", F.col("week").cast("date"))


@query("agg_06_overall_hashtag_counts", upto("hashtags", "SELECT tag, count(*) AS count FROM hashtags GROUP BY tag"))
def overall_hashtags(spark, sf):
    return counts.overall_counts(t.cleaned(spark, sf))


@query("agg_06_overall_cashtag_counts", upto("cashtags", "SELECT tag, count(*) AS count FROM cashtags GROUP BY tag"))
def overall_cashtags(spark, sf):
    return counts.overall_counts(t.cleaned(spark, sf), "cashtags")


@query("agg_07_token_totals", JSON_STEPS + "SELECT kind, count(*) AS tokens FROM raw_tokens GROUP BY kind")
def token_totals(spark, sf):
    return corpus.token_totals(t.tokens(spark, sf))


@query("agg_08_shape", upto("features", 'SELECT count(*) AS "rows", 23 AS "columns" FROM features'))
def shape(spark, sf):
    return counts.shape(t.features(spark, sf)).withColumn("columns", F.col("columns").cast("int"))


@query("agg_09_tag_totals_and_days", upto("summary", "SELECT tag_type, tag, total_count, observed_days FROM summary"))
def tag_summary(spark, sf):
    return counts.tag_summary(t.lazy_counts(spark, sf))


@query("agg_10_sum_of_daily_counts", upto("daily_h", "SELECT tag, CAST(sum(count) AS BIGINT) AS total FROM daily_h GROUP BY tag"))
def sum_of_daily(spark, sf):
    return counts.totals_by(t.daily(spark, sf), "tag", name="total")


@query("agg_11_distinct_tags_by_type", upto("counts", "SELECT tag_type, count(DISTINCT tag) AS tags FROM counts GROUP BY tag_type"))
def distinct_tags(spark, sf):
    return counts.distinct_tags_by_type(t.lazy_counts(spark, sf))


@query("agg_12_value_counts", upto("modeling", "SELECT split, count(*) AS count FROM modeling GROUP BY split"))
def value_counts(spark, sf):
    return counts.value_counts(t.modeling(spark, sf), "split", splits.SPLIT_ORDER)


@query("agg_13_mae", upto("rowwise", 'SELECT model, round(avg(abs_error), 6) + 0 AS "MAE" FROM rowwise GROUP BY model'))
def mae(spark, sf):
    rows = fc.scored(t.predictions(spark, sf)).groupBy("model")
    return t.rounded(rows.agg(mx.mean_absolute_error(F.col(fc.TARGET), F.col("prediction")).alias("MAE")), "MAE")


@query("agg_14_rmse", upto("rowwise", 'SELECT model, round(sqrt(avg(residual * residual)), 6) + 0 AS "RMSE" FROM rowwise GROUP BY model'))
def rmse(spark, sf):
    rows = fc.scored(t.predictions(spark, sf)).groupBy("model")
    return t.rounded(rows.agg(mx.root_mean_squared_error(F.col(fc.TARGET), F.col("prediction")).alias("RMSE")), "RMSE")


@query("agg_15_smape", upto("rowwise", 'SELECT model, round(avg(row_smape), 6) + 0 AS "sMAPE" FROM rowwise GROUP BY model'))
def smape(spark, sf):
    rows = fc.scored(t.predictions(spark, sf)).groupBy("model")
    return t.rounded(rows.agg(mx.mean_smape(F.col(fc.TARGET), F.col("prediction")).alias("sMAPE")), "sMAPE")


@query("agg_16_metric_row", upto("rowwise", f"SELECT \"rows\", {METRICS} FROM (SELECT count(*) AS \"rows\", avg(abs_error) AS \"MAE\", sqrt(avg(residual * residual)) AS \"RMSE\", avg(row_smape) AS \"sMAPE\" FROM rowwise)"))
def metric_row(spark, sf):
    rows = fc.scored(t.predictions(spark, sf))
    return t.rounded(rows.agg(*mx.error_metrics(fc.TARGET, "prediction")), *t.METRICS)


@query("agg_17_metrics_by_split_and_baseline", upto("overall", f'SELECT split, model AS baseline, "rows", {METRICS} FROM overall'))
def overall(spark, sf):
    long = fc.long_forecasts(t.baselines(spark, sf))
    return t.rounded(fc.sorted_overall(fc.overall_metrics(long, "baseline"), "baseline"), *t.METRICS)


@query("agg_18_metrics_by_tag", upto("by_tag", f"SELECT {BY_TAG} AND model = 'baseline_last_value'"))
def by_tag(spark, sf):
    return t.rounded(fc.metrics_by_tag(t.predictions(spark, sf), "baseline_last_value"), *t.METRICS)


@query("agg_19_metrics_by_type", upto("by_type", f'SELECT split, tag_type, model, "rows", {METRICS} FROM by_type'))
def by_type(spark, sf):
    return t.rounded(fc.metrics_by_type(t.predictions(spark, sf)), *t.METRICS)


@query("agg_20_all_metrics_in_one_pass", upto("by_tag", f"""SELECT level, split, tag_type, tag, model, "rows", {METRICS} FROM (
 SELECT 'overall' AS level, split, CAST(NULL AS VARCHAR) AS tag_type, CAST(NULL AS VARCHAR) AS tag, model, "rows", "MAE", "RMSE", "sMAPE" FROM overall
 UNION ALL SELECT 'by_type', split, tag_type, NULL, model, "rows", "MAE", "RMSE", "sMAPE" FROM by_type
 UNION ALL SELECT 'by_tag', split, tag_type, tag, model, "rows", "MAE", "RMSE", "sMAPE" FROM by_tag)"""))
def all_metrics(spark, sf):
    return t.rounded(fc.all_metrics(t.predictions(spark, sf)), *t.METRICS)


_BUCKETED = """edges AS (SELECT quantile_cont(actual, [0, 0.25, 0.5, 0.75, 1]) AS raw FROM evaluated),
bucketed AS (SELECT e.*, greatest(len([x FOR x IN list_distinct(raw) IF x < actual]) - 1, 0) AS bucket, list_sort(list_distinct(raw)) AS edges FROM evaluated e, edges)"""


def _buckets(select: str) -> str:
    return upto("evaluated", "") + ", " + _BUCKETED + "\n" + select


@query("agg_21_measures_per_bucket", _buckets("""SELECT bucket, measure, count(*) AS count, round(avg(value), 6) + 0 AS mean, round(quantile_cont(value, 0.5), 6) + 0 AS median
 FROM (SELECT bucket, actual, row_smape, abs_error FROM bucketed) UNPIVOT (value FOR measure IN (actual, row_smape, abs_error)) GROUP BY bucket, measure"""))
def per_bucket(spark, sf):
    rows = dg.error_by_bucket(t.evaluated(spark, sf))
    return t.rounded(rows.withColumn("bucket", F.col("bucket").cast("long")), "mean", "median")


@query("agg_22_mean_and_median_residual", upto("evaluated", "SELECT round(avg(residual), 2) + 0 AS mean_residual, round(quantile_cont(residual, 0.5), 2) + 0 AS median_residual FROM evaluated"))
def residuals(spark, sf):
    return t.rounded(dg.residual_summary(t.evaluated(spark, sf)), "mean_residual", "median_residual")


@query("agg_23_date_range_and_axis_limit", upto("evaluated", "SELECT min(date) AS first_date, max(date) AS last_date, round(greatest(max(actual), max(prediction)), 6) + 0 AS axis_limit FROM evaluated"))
def ranges(spark, sf):
    rows = t.evaluated(spark, sf)
    limit = dg.axis_limit(rows).scalar()
    return t.rounded(counts.date_range(rows).withColumn("axis_limit", limit), "axis_limit")


@query("agg_24_describe", "SELECT measure, count(value) AS count, round(avg(value), 6) + 0 AS mean, round(stddev_samp(value), 6) + 0 AS std, round(min(value), 6) + 0 AS min, round(quantile_cont(value, 0.25), 6) + 0 AS q25, round(quantile_cont(value, 0.5), 6) + 0 AS q50, round(quantile_cont(value, 0.75), 6) + 0 AS q75, round(max(value), 6) + 0 AS max FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount FROM lineitem) UNPIVOT (value FOR measure IN (l_quantity, l_extendedprice, l_discount)) GROUP BY measure")
def describe(spark, sf):
    rows = qt.describe_columns(t.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return t.rounded(rows, "mean", "std", "min", "q25", "q50", "q75", "max")


@query("agg_25_coverage", upto("features", "SELECT round(avg(CASE WHEN anomaly_z_ready_7 > 0 THEN 1 ELSE 0 END), 6) + 0 AS coverage FROM features"))
def coverage(spark, sf):
    return t.rounded(counts.positive_share(t.features(spark, sf), "anomaly_z_ready_7"), "coverage")


@query("agg_26_exact_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) + 0 AS median, round(quantile_cont(value, 0.98), 6) + 0 AS q98 FROM events GROUP BY event_type")
def quantiles(spark, sf):
    found = qt.exact_quantiles(t.table(spark, sf, "events"), "value", [0.5, 0.98], ["event_type"])
    pair = found.select("event_type", F.get("quantiles", F.lit(0)).alias("median"), F.get("quantiles", F.lit(1)).alias("q98"))
    return t.rounded(pair, "median", "q98")


@query("agg_27_train_mean_and_std", upto("modeling", "SELECT round(avg(target_next_count), 6) + 0 AS mean, round(stddev_pop(target_next_count), 6) + 0 AS std FROM modeling WHERE split = 'train'"))
def train_moments(spark, sf):
    return t.rounded(scaling.split_moments(t.modeling(spark, sf), fc.TARGET), "mean", "std")


@query("agg_28_most_frequent_value", "SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, source LIMIT 1")
def most_frequent(spark, sf):
    return counts.most_frequent(t.table(spark, sf, "documents"), "source")


@query("agg_29_sum_of_map_values", upto("long", f"SELECT CAST(sum(train_seconds) AS DOUBLE) AS total_training_seconds FROM {_TIMES}"))
def map_values(spark, sf):
    seconds = reshape.rows_to_map(_times(t.predictions(spark, sf)), "model", "train_seconds")
    return seconds.select(reshape.map_total(F.col("map")).alias("total_training_seconds"))


@query("agg_30_box_plot", _buckets("""SELECT b.bucket, round(least(min(CASE WHEN row_smape >= q1 - 1.5 * (q3 - q1) THEN row_smape END), q1), 6) + 0 AS whisker_low, round(q1, 6) + 0 AS q1, round(med, 6) + 0 AS median, round(q3, 6) + 0 AS q3,
 round(greatest(max(CASE WHEN row_smape <= q3 + 1.5 * (q3 - q1) THEN row_smape END), q3), 6) + 0 AS whisker_high
 FROM bucketed b JOIN (SELECT bucket, quantile_cont(row_smape, 0.25) AS q1, quantile_cont(row_smape, 0.5) AS med, quantile_cont(row_smape, 0.75) AS q3 FROM bucketed GROUP BY bucket) q ON b.bucket = q.bucket GROUP BY b.bucket, q1, med, q3"""))
def box_plot(spark, sf):
    rows = staged(buckets.quantile_buckets(t.evaluated(spark, sf), "actual"), "buckets")
    plot = buckets.box_plot(rows, "row_smape", ["bucket"], groups=4)
    return t.rounded(plot.withColumn("bucket", F.col("bucket").cast("long")), "whisker_low", "q1", "median", "q3", "whisker_high")


@query("agg_31_share_of_top_k", upto("daily_c", "SELECT tag, CAST(total AS BIGINT) AS total, round(total * 100.0 / sum(total) OVER (), 6) + 0 AS share FROM (SELECT tag, sum(count) AS total FROM daily_c GROUP BY tag ORDER BY total DESC, tag LIMIT 10)"))
def share(spark, sf):
    totals = counts.totals_by(t.daily(spark, sf, "cashtags"), "tag", name="total")
    return t.rounded(rk.share_of_total(rk.top_k(totals, 10, [F.desc("total"), "tag"]), "total"), "share")


@query("agg_32_date_spine", upto("spine", "SELECT date FROM spine"))
def spine(spark, sf):
    return panel.distinct_dates(t.lazy_counts(spark, sf))
