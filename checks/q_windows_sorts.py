"""Windows, sorts, top-k, set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from checks.sql import JSON_STEPS, rounded, upto
from tagloom.operators import clean, counts, features as ft, forecasts as fc, panel, quality
from tagloom.operators import diagnostics as dg
from tagloom.operators import ranking as rk
from tagloom.operators.corpus import combined_corpus
from tagloom.session import staged

KEYS = "tag_type, tag, date"
METRICS = rounded("MAE", "RMSE", "sMAPE")


# ---- windows

@query("win_01_next_day_target", upto("lagged", f"SELECT {KEYS}, target_next_count FROM lagged"))
def next_day(spark, sf):
    return t.panel(spark, sf).select("tag_type", "tag", "date", ft.next_value().alias("target_next_count"))


@query("win_02_lags", upto("lagged", f"SELECT {KEYS}, count_lag_1, count_lag_2, count_lag_3, count_lag_7 FROM lagged"))
def lags(spark, sf):
    return t.panel(spark, sf).select("tag_type", "tag", "date", *[ft.lagged(k).alias(f"count_lag_{k}") for k in ft.LAGS])


@query("win_03_rolling_mean", upto("lagged", f"SELECT {KEYS}, {rounded('rolling_mean_3', 'rolling_mean_7')} FROM lagged"))
def rolling_mean(spark, sf):
    rows = t.panel(spark, sf).select("tag_type", "tag", "date", *[ft.rolling_mean(n).alias(f"rolling_mean_{n}") for n in ft.WINDOWS])
    return t.rounded(rows, "rolling_mean_3", "rolling_mean_7")


@query("win_04_rolling_std", upto("lagged", f"SELECT {KEYS}, {rounded('rolling_std_3', 'rolling_std_7')} FROM lagged"))
def rolling_std(spark, sf):
    rows = t.panel(spark, sf).select("tag_type", "tag", "date", *[ft.rolling_std(n).alias(f"rolling_std_{n}") for n in ft.WINDOWS])
    return t.rounded(rows, "rolling_std_3", "rolling_std_7")


@query("win_05_trailing_statistics", upto("features", f"SELECT {KEYS}, {rounded('anomaly_trailing_mean_7', 'anomaly_trailing_std_7')} FROM features"))
def trailing(spark, sf):
    rows = t.features(spark, sf).select("tag_type", "tag", "date", "anomaly_trailing_mean_7", "anomaly_trailing_std_7")
    return t.rounded(rows, "anomaly_trailing_mean_7", "anomaly_trailing_std_7")


@query("win_06_anomaly_score", upto("features", f"SELECT {KEYS}, {rounded('anomaly_deviation_7', 'anomaly_z_ready_7')} FROM features"))
def anomaly(spark, sf):
    rows = t.features(spark, sf).select("tag_type", "tag", "date", "anomaly_deviation_7", "anomaly_z_ready_7")
    return t.rounded(rows, "anomaly_deviation_7", "anomaly_z_ready_7")


@query("win_07_row_position", upto("lagged", f"SELECT {KEYS}, CAST(day_index AS INTEGER) AS day_index FROM lagged"))
def position(spark, sf):
    return t.panel(spark, sf).select("tag_type", "tag", "date", ft.row_position().alias("day_index"))


@query("win_08_date_positions", upto("positions", "SELECT date, CAST(date_position AS INTEGER) AS date_position FROM positions"))
def date_positions(spark, sf):
    return panel.date_positions(t.lazy_counts(spark, sf))


@query("win_09_difference_and_change", upto("features", f"SELECT {KEYS}, count_diff_1, round(count_pct_change_1, 6) + 0 AS count_pct_change_1, CAST(day_of_week AS INTEGER) AS day_of_week FROM features"))
def change(spark, sf):
    rows = t.features(spark, sf).select("tag_type", "tag", "date", "count_diff_1", "count_pct_change_1", "day_of_week")
    return t.rounded(rows, "count_pct_change_1")


@query("win_10_top_n_per_type", upto("selected", "SELECT tag_type, tag, total_count, observed_days FROM selected"))
def top_n(spark, sf):
    return t.selected(t.lazy_counts(spark, sf))


@query("win_10_top_n_per_lang_and_source", "SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rk FROM documents) WHERE rk <= 3")
def top_documents(spark, sf):
    rows = t.table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    return rk.top_per_group(rows, 3, ["lang", "source"], [F.desc("n_chars"), "doc_id"])


@query("win_11_best_row_per_group", upto("overall", f"SELECT split, model, \"rows\", {METRICS} FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY \"sMAPE\", \"MAE\", model) AS rk FROM overall) WHERE rk = 1"))
def best_row(spark, sf):
    return t.rounded(fc.best_per_split(fc.overall_metrics(t.predictions(spark, sf))), *t.METRICS)


@query("win_11_representative_tags", upto("long", "SELECT tag_type, tag, volume FROM (SELECT *, row_number() OVER (PARTITION BY tag_type ORDER BY volume DESC, tag) AS rk FROM (SELECT tag_type, tag, sum(target_next_count) AS volume FROM long WHERE model = 'baseline_lag_7' GROUP BY tag_type, tag)) WHERE rk = 1"))
def representative(spark, sf):
    rows = t.predictions(spark, sf).where("model = 'baseline_lag_7'")
    return fc.representative_tags(rows)


# Each scored date stands for one epoch of a training history.
HISTORY = """(SELECT row_number() OVER (ORDER BY date) AS epoch, train_loss, "validation_MAE", "validation_sMAPE" FROM (
 SELECT date, avg(residual * residual) AS train_loss, round(avg(abs_error), 6) AS "validation_MAE", round(avg(row_smape), 6) AS "validation_sMAPE" FROM evaluated GROUP BY date))"""


def history(spark, sf):
    per_date = t.evaluated(spark, sf).groupBy("date").agg(
        F.avg(F.col("residual") * F.col("residual")).alias("train_loss"),
        F.round(F.avg("abs_error"), 6).alias("validation_MAE"),
        F.round(F.avg("row_smape"), 6).alias("validation_sMAPE"),
    )
    per_date = staged(per_date, "history")
    epochs = panel.date_positions(per_date).select("date", (F.col("date_position") + 1).cast("long").alias("epoch"))
    return per_date.join(epochs, "date").drop("date")


@query("win_12_running_best_epoch", upto("evaluated", f'SELECT epoch, "validation_sMAPE", best_before, best_before IS NULL OR "validation_sMAPE" < best_before AS improved FROM (SELECT *, min("validation_sMAPE") OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {HISTORY})'))
def running_best(spark, sf):
    return fc.running_best(history(spark, sf)).select("epoch", "validation_sMAPE", "best_before", "improved")


# The stored target of cashtags is spoilt, so that there is something to find.
_STALE = "CASE WHEN tag_type = 'cashtag' THEN CAST(count AS DOUBLE) ELSE target_next_count END"


@query("win_13_target_recomputed", upto("lagged", f"SELECT tag_type, tag, date, stale AS target_next_count, target_next_count AS expected FROM (SELECT *, {_STALE} AS stale FROM lagged) WHERE abs(coalesce(stale, -1) - coalesce(target_next_count, -1)) > 1e-8 + 1e-5 * abs(coalesce(target_next_count, -1))"))
def target_recomputed(spark, sf):
    rows = t.features(spark, sf).withColumn("target_next_count", F.expr(_STALE))
    return quality.target_mismatches(rows)


@query("win_all_feature_columns", upto("features", f"""SELECT {KEYS}, count, target_next_count, count_lag_1, count_lag_2, count_lag_3, count_lag_7,
 {rounded('rolling_mean_3', 'rolling_std_3', 'rolling_mean_7', 'rolling_std_7', 'count_pct_change_1', 'anomaly_deviation_7', 'anomaly_z_ready_7')}, count_diff_1,
 CAST(day_of_week AS INTEGER) AS day_of_week, CAST(day_index AS INTEGER) AS day_index, split, modeling_ready FROM features"""))
def all_features(spark, sf):
    doubles = ("rolling_mean_3", "rolling_std_3", "rolling_mean_7", "rolling_std_7", "count_pct_change_1", "anomaly_deviation_7", "anomaly_z_ready_7")
    return t.rounded(t.features(spark, sf).drop("anomaly_trailing_mean_7", "anomaly_trailing_std_7"), *doubles)


# ---- sorts and top-k

@query("srt_01_sorted_word_counts", "SELECT *, row_number() OVER (ORDER BY count DESC, word) - 1 AS position FROM (SELECT word, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word)")
def sorted_words(spark, sf):
    words = t.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return t.positioned(rk.by_count(counts.word_count(words, "word"), "word"))


@query("srt_02_by_date_and_count", upto("daily_h", "SELECT date, tag, count, row_number() OVER (ORDER BY date NULLS FIRST, count DESC, tag) - 1 AS position FROM daily_h"))
def by_date(spark, sf):
    return t.positioned(rk.by_date_and_count(t.daily(spark, sf)))


@query("srt_03_top_10_tags", upto("hashtags", "SELECT tag, count(*) AS count FROM hashtags GROUP BY tag ORDER BY count DESC, tag LIMIT 10"))
def top_10(spark, sf):
    return rk.top_k(counts.overall_counts(t.cleaned(spark, sf)), 10, [F.desc("count"), "tag"])


def _top(k: int, table: str = "daily_h") -> str:
    return upto(table, f"SELECT tag, CAST(sum(count) AS BIGINT) AS count FROM {table} GROUP BY tag ORDER BY count DESC, tag LIMIT {k}")


@query("srt_04_top_20_by_total", _top(20))
def top_20(spark, sf):
    return rk.top_k(counts.totals_by(t.daily(spark, sf), "tag"), 20, [F.desc("count"), "tag"])


@query("srt_04_top_10_weekly", _top(10, "weekly_h"))
def top_weekly(spark, sf):
    return rk.top_k(counts.totals_by(counts.weekly_counts(t.cleaned(spark, sf)), "tag"), 10, [F.desc("count"), "tag"])


@query("srt_05_highest_errors_ascending", upto("by_tag", f"SELECT *, row_number() OVER (ORDER BY \"sMAPE\", tag_type DESC, tag DESC) - 1 AS position FROM (SELECT tag_type, tag, model, \"rows\", {METRICS} FROM by_tag WHERE split = 'test' AND model = 'baseline_last_value' ORDER BY round(by_tag.\"sMAPE\", 6) DESC, tag_type, tag LIMIT 15)"))
def highest_errors(spark, sf):
    rows = fc.metrics_by_tag(t.predictions(spark, sf), "baseline_last_value")
    return t.positioned(rk.top_k_reversed(t.rounded(rows, *t.METRICS), 15, "sMAPE", ["tag_type", "tag"]))


@query("srt_06_worst_misses", upto("evaluated", f"""SELECT side, {KEYS}, actual, {rounded('prediction', 'residual', 'row_smape')} FROM (
 (SELECT 'over' AS side, * FROM evaluated ORDER BY residual DESC, tag_type, tag, date LIMIT 8) UNION ALL
 (SELECT 'under' AS side, * FROM evaluated ORDER BY residual, tag_type, tag, date LIMIT 8))"""))
def worst_misses(spark, sf):
    rows = dg.worst_misses(t.evaluated(spark, sf))
    picked = rows.select("side", "tag_type", "tag", "date", "actual", "prediction", "residual", "row_smape")
    return t.rounded(picked, "prediction", "residual", "row_smape")


_GAPS = """gaps AS (SELECT a.tag_type, a.tag, round(b."sMAPE" - a."sMAPE", 9) AS gap FROM by_tag a JOIN by_tag b ON a.tag_type = b.tag_type AND a.tag = b.tag
 WHERE a.split = 'test' AND b.split = 'test' AND a.model = 'baseline_last_value' AND b.model = 'baseline_rolling_mean_3')"""


@query("srt_07_improvements_and_regressions", upto("by_tag", "") + ", " + _GAPS + """ SELECT side, tag_type, tag, round(gap, 6) + 0 AS gap FROM (
 (SELECT 'regression' AS side, * FROM gaps ORDER BY gap DESC, tag_type, tag LIMIT 10) UNION ALL (SELECT 'improvement' AS side, * FROM gaps ORDER BY gap, tag_type, tag LIMIT 10))""")
def improvements(spark, sf):
    rows = t.stored_predictions(spark, sf)
    last = fc.metrics_by_tag(rows, "baseline_last_value")
    mean = fc.metrics_by_tag(rows, "baseline_rolling_mean_3")
    gaps = fc.compare_errors(last, mean, "last", "mean").select("tag_type", "tag", F.round("mean_minus_last", 9).alias("gap"))
    return t.rounded(rk.extremes(gaps, 10, "gap", ["tag_type", "tag"], ("regression", "improvement")), "gap")


@query("srt_08_sorted_metric_tables", upto("by_tag", f"SELECT *, row_number() OVER (ORDER BY \"MAE\" DESC, \"sMAPE\" DESC, tag_type, tag) - 1 AS position FROM (SELECT tag_type, tag, model, \"rows\", {METRICS} FROM by_tag WHERE split = 'test' AND model = 'baseline_lag_7')"))
def sorted_metrics(spark, sf):
    rows = fc.metrics_by_tag(t.predictions(spark, sf), "baseline_lag_7")
    return t.positioned(fc.sorted_by_tag(t.rounded(rows, *t.METRICS)))


@query("srt_09_first_rows", upto("features", f"SELECT {KEYS}, count FROM features ORDER BY {KEYS} LIMIT 5"))
def first_rows(spark, sf):
    return rk.top_k(t.features(spark, sf), 5, ["tag_type", "tag", "date"]).select("tag_type", "tag", "date", "count")


@query("srt_10_canonical_order", upto("panel", f"SELECT date, tag, tag_type, count, row_number() OVER (ORDER BY {KEYS}) - 1 AS position FROM panel"))
def canonical(spark, sf):
    return t.positioned(panel.canonical_order(t.panel(spark, sf)))


# ---- set operations

@query("set_01_union_of_counts", upto("daily_c", "SELECT date, tag, 'hashtag' AS tag_type, count FROM daily_h UNION ALL SELECT date, tag, 'cashtag', count FROM daily_c"))
def union_counts(spark, sf):
    tweets_once = staged(t.cleaned(spark, sf).select("date", "hashtags", "cashtags"), "cleaned")
    return panel.union_counts(counts.daily_counts(tweets_once), counts.daily_counts(tweets_once, "cashtags"))


@query("set_02_union_of_metrics", upto("overall", f"""SELECT source, split, model, "rows", {METRICS} FROM (SELECT 'baseline' AS source, * FROM overall WHERE model <> 'baseline_lag_7'
 UNION ALL SELECT 'learned', * FROM overall WHERE model = 'baseline_lag_7')"""))
def union_metrics(spark, sf):
    rows = staged(fc.overall_metrics(t.predictions(spark, sf)), "metrics")
    named = rows.where("model <> 'baseline_lag_7'").withColumnRenamed("model", "baseline")
    together = fc.combined_metrics({"baseline": named, "learned": rows.where("model = 'baseline_lag_7'")})
    return t.rounded(together.select("source", *fc.METRIC_COLUMNS), *t.METRICS)


@query("set_03_combined_corpus", JSON_STEPS + "SELECT token, count(*) AS count FROM raw_tokens GROUP BY token")
def combined(spark, sf):
    rows = staged(t.tokens(spark, sf), "tokens")
    parts = [rows.where(F.col("kind") == kind).select("token") for kind in ("hashtag", "url")]
    return combined_corpus(*parts).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


@query("set_04_dedupe_by_text", "SELECT text, doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rk FROM documents) WHERE rk = 1")
def dedupe(spark, sf):
    rows = t.table(spark, sf, "documents").select("text", "doc_id", "lang", "source", "n_chars")
    return clean.dedupe_text(rows, ["doc_id"])


@query("set_04_distinct_tweets", upto("cleaned", "SELECT text, date FROM cleaned"))
def distinct_tweets(spark, sf):
    return clean.distinct_texts(t.tweets(spark, sf))


@query("set_05_distinct_tags", upto("counts", "SELECT DISTINCT tag_type, tag FROM counts"))
def distinct_tags(spark, sf):
    return panel.distinct_tags(t.lazy_counts(spark, sf))


@query("set_06_distinct_sorted_values", upto("long", "SELECT model, row_number() OVER (ORDER BY model) - 1 AS position FROM (SELECT DISTINCT model FROM long)"))
def distinct_models(spark, sf):
    return t.positioned(t.predictions(spark, sf).select("model").distinct().orderBy("model"))
