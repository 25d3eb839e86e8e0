"""Splits, preparation, model fits and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.q_windows_sorts import HISTORY, history
from checks.registry import query
from checks.sql import rounded, upto
from tagloom.operators import forecasts as fc
from tagloom.operators import models as ml
from tagloom.operators import pooled, scaling, splits
from tagloom.operators.panel import concat_all
from tagloom.plans import forecasting
from tagloom.plans.feature_table import PanelSettings, feature_table
from tagloom.session import staged

METRICS = rounded("MAE", "RMSE", "sMAPE")


@query("ml_01_time_ordered_split", upto("features", "SELECT split, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, count(*) AS \"rows\" FROM features GROUP BY split"))
def time_split(spark, sf):
    rows = splits.add_splits(staged(t.panel(spark, sf), "panel"), t.TRAIN, t.VALIDATION)
    return rows.groupBy("split").agg(
        F.count_distinct("date").alias("dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("rows"),
    )


# Values below 2 count as missing here, so that there is something to impute.
_GAPPY = {c: f"CASE WHEN {c} < 2 THEN NULL ELSE CAST({c} AS DOUBLE) END" for c in ("count", "count_lag_1", "rolling_mean_3")}


def _scaled_sql() -> str:
    gappy = ", ".join(f"{e} AS {c}" for c, e in _GAPPY.items())
    medians = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in _GAPPY)
    filled = ", ".join(f"coalesce({c}, med_{c}) AS {c}" for c in _GAPPY)
    moments = ", ".join(f"avg({c}) AS avg_{c}, stddev_pop({c}) AS std_{c}" for c in _GAPPY)
    scaled = ", ".join(f"round(({c} - avg_{c}) / CASE WHEN std_{c} = 0 THEN 1 ELSE std_{c} END, 6) + 0 AS {c}_scaled" for c in _GAPPY)
    return upto(
        "modeling",
        f"SELECT date, tag, tag_type, {scaled} FROM filled, moments",
        {
            "gappy": f"SELECT date, tag, tag_type, split, {gappy} FROM modeling",
            "medians": f"SELECT {medians} FROM gappy WHERE split = 'train'",
            "filled": f"SELECT date, tag, tag_type, split, {filled} FROM gappy, medians",
            "moments": f"SELECT {moments} FROM filled WHERE split = 'train'",
        },
    )


@query("ml_02_impute_and_standardise", _scaled_sql())
def impute(spark, sf):
    rows = t.stored_features(spark, sf).where("modeling_ready")
    gappy = rows.withColumns({c: F.expr(e) for c, e in _GAPPY.items()})
    fitted = scaling.fit_scaling(gappy.where("split = 'train'"), list(_GAPPY))
    names = [f"{c}_scaled" for c in _GAPPY]
    return t.rounded(fitted.apply(gappy).select("date", "tag", "tag_type", *names), *names)


@query("ml_03_one_hot_slots", upto("modeling", "SELECT 'tag' AS feature, tag AS category, count(*) AS \"rows\" FROM modeling GROUP BY tag UNION ALL SELECT 'tag_type', tag_type, count(*) FROM modeling GROUP BY tag_type"))
def one_hot(spark, sf):
    rows = t.stored_features(spark, sf).where("modeling_ready")
    encoder = ml.fit_encoder(rows)
    return concat_all(
        [ml.category_totals(encoder, rows, c).withColumn("feature", F.lit(c)) for c in ("tag", "tag_type")]
    )


_TABLES: dict = {}
_RUNS: dict[tuple[str, str], ml.FittedModels] = {}


def _fitted_rows(spark, sf):
    """The rows the shared fits are made on, derived and stored once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        _TABLES[key] = t.stored_features(spark, sf).where("modeling_ready")
    return _TABLES[key]


def _fitted(spark, sf) -> ml.FittedModels:
    """All four configurations; queries of one session over the same tables share the fits."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = ml.fit_models(_fitted_rows(spark, sf))
    return _RUNS[key]


def _predicted(spark, sf, kind: str):
    name = next(c.name for c in ml.MODEL_CONFIGS if c.kind == kind)
    return _fitted(spark, sf).predictions.where(F.col("model") == name)


_MODEL_NAMES = "unnest(['linear_regression_pooled', 'ridge_regression_pooled', 'random_forest_pooled', 'hist_gradient_boosting_pooled'])"


_FEATURES = (
    "SELECT unnest(['count', 'count_lag_1', 'count_lag_2', 'count_lag_3', 'count_lag_7', 'rolling_mean_3', 'rolling_mean_7', "
    "'rolling_std_3', 'rolling_std_7', 'count_diff_1', 'count_pct_change_1']) AS feature UNION ALL SELECT DISTINCT 'tag=' || tag "
    "FROM modeling WHERE split = 'train' UNION ALL SELECT DISTINCT 'tag_type=' || tag_type FROM modeling WHERE split = 'train'"
)


def _optimum(train, alpha: float, design=None, target: str = fc.TARGET):
    """Every column and tag must satisfy the normal equations of the fit."""
    fit = pooled.fit_pooled(train, {"fit": alpha}, design, target)["fit"]
    checked = pooled.optimum_gaps(train, fit, target).where("feature <> 'intercept'")
    return checked.select("feature", (F.col("imbalance") < 1e-5).alias("optimal"))


def _train(spark, sf):
    return t.stored_features(spark, sf).where("modeling_ready and split = 'train'")


@query("ml_04_linear_regression_normal_equations", upto("modeling", f"SELECT feature, true AS optimal FROM ({_FEATURES})"))
def linear_optimum(spark, sf):
    return _optimum(_train(spark, sf), 0.0)


@query("ml_05_ridge_regression_normal_equations", upto("modeling", f"SELECT feature, true AS optimal FROM ({_FEATURES})"))
def ridge_optimum(spark, sf):
    return _optimum(_train(spark, sf), 10.0)


_MANY_FEATURES = """SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature UNION ALL SELECT DISTINCT 'l_orderkey=' || l_orderkey FROM lineitem
 UNION ALL SELECT DISTINCT 'l_returnflag=' || l_returnflag FROM lineitem"""


def _many_tags(spark, sf, alpha: float):
    """An effect for each order, so the number of slots grows with the table."""
    rows = t.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    design = pooled.design_of(rows, ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_returnflag"])
    return _optimum(rows, alpha, design, "l_extendedprice")


@query("ml_04_least_squares_with_a_slot_per_order", f"SELECT feature, true AS optimal FROM ({_MANY_FEATURES})")
def linear_many(spark, sf):
    return _many_tags(spark, sf, 0.0)


@query("ml_05_ridge_with_a_slot_per_order", f"SELECT feature, true AS optimal FROM ({_MANY_FEATURES})")
def ridge_many(spark, sf):
    return _many_tags(spark, sf, 10.0)


@query("ml_04_linear_regression_keeps_tag_means", upto("modeling", "SELECT tag_type, tag, count(*) AS \"rows\", round(avg(target_next_count), 3) + 0 AS mean_target, round(avg(target_next_count), 3) + 0 AS mean_prediction FROM modeling WHERE split = 'train' GROUP BY tag_type, tag"))
def linear_means(spark, sf):
    """Least squares with one slot per tag leaves no residual per tag: its train means are exact."""
    train = _train(spark, sf)
    fit = pooled.fit_pooled(train, {"raw": 0.0})["raw"]
    means = pooled.with_predictions(train, {"raw_prediction": fit}).groupBy("tag_type", "tag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(fc.TARGET).alias("mean_target"),
        F.avg("raw_prediction").alias("mean_prediction"),
    )
    return t.rounded(means, "mean_target", "mean_prediction", digits=3)


def _scores(predictions):
    return t.rounded(fc.overall_metrics(predictions), *t.METRICS, digits=3)


@query("ml_04_linear_regression")
def linear(spark, sf):
    return _scores(_predicted(spark, sf, "linear_regression"))


@query("ml_05_ridge_regression")
def ridge(spark, sf):
    return _scores(_predicted(spark, sf, "ridge"))


@query("ml_06a_random_forest")
def forest(spark, sf):
    return _scores(_predicted(spark, sf, "random_forest"))


@query("ml_06b_gradient_boosting")
def boosting(spark, sf):
    return _scores(_predicted(spark, sf, "gradient_boosting"))


@query("ml_07_several_models_side_by_side", upto("scored", f"""SELECT name AS model, split, count(*) AS "rows" FROM scored s CROSS JOIN (SELECT {_MODEL_NAMES} AS name)
 WHERE s.model = 'baseline_lag_7' GROUP BY ALL"""))
def side_by_side(spark, sf):
    predictions = _fitted(spark, sf).predictions
    return predictions.groupBy("model", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("ml_08_clipped_predictions", upto("scored", f"SELECT date, tag, tag_type, target_next_count, split, name AS model, true AS clipped FROM scored s CROSS JOIN (SELECT {_MODEL_NAMES} AS name) WHERE s.model = 'baseline_lag_7'"))
def clipped(spark, sf):
    rows = _fitted(spark, sf).predictions
    return rows.withColumn("clipped", F.col("prediction") >= 0).drop("prediction")


# A constant prediction, the train mean, is what a learned model must at least match on the rows it learned the scale from.
@query("ml_06_trees_beat_the_mean", upto("scored", """SELECT model, split, n AS "rows", true AS within_range, true AS beats_mean FROM (SELECT unnest(['random_forest_pooled', 'hist_gradient_boosting_pooled']) AS model),
 (SELECT split, count(*) AS n FROM scored WHERE model = 'baseline_lag_7' GROUP BY split)"""))
def trees_beat_the_mean(spark, sf):
    """Rows scored, predictions inside the targets' range (with the margin of boosting), errors below those of the train mean."""
    learned = _fitted(spark, sf).predictions.where(F.col("model").isin("random_forest_pooled", "hist_gradient_boosting_pooled"))
    train = _fitted_rows(spark, sf).where("split = 'train'")
    known = train.agg(F.struct(F.avg(fc.TARGET).alias("mean"), F.min(fc.TARGET).alias("lo"), F.max(fc.TARGET).alias("hi"))).scalar()
    rows = learned.withColumn("_known", known)
    spread = F.col("_known.hi") - F.col("_known.lo")
    inside = F.col("prediction").between(F.greatest(F.lit(0.0), F.col("_known.lo") - spread / 10), F.col("_known.hi") + spread / 10)
    errors = (F.col(fc.TARGET) - F.col("prediction")) ** 2, (F.col(fc.TARGET) - F.col("_known.mean")) ** 2
    return rows.groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.every(inside).alias("within_range"), (F.sum(errors[0]) < F.sum(errors[1])).alias("beats_mean")
    )


@query("ml_09_official_baseline_added", upto("overall", f'SELECT split, model, "rows", {METRICS} FROM overall WHERE model IN (\'baseline_lag_7\', \'baseline_last_value\')'))
def official(spark, sf):
    wide = staged(t.baselines(spark, sf), "baselines")
    learned = fc.scored(fc.long_forecasts(wide, ["baseline_lag_7"], "model"))
    rows = fc.add_official_baseline(learned, wide)
    return t.rounded(fc.overall_metrics(rows), *t.METRICS)


@query("ml_09_official_baseline_metrics_added", upto("overall", f'SELECT split, model, "rows", {METRICS} FROM overall WHERE model IN (\'baseline_lag_7\', \'baseline_last_value\')'))
def official_metrics(spark, sf):
    metrics = staged(fc.overall_metrics(t.predictions(spark, sf)), "metrics")
    learned = metrics.where("model = 'baseline_lag_7'")
    return t.rounded(fc.add_baseline_metrics(learned, metrics.withColumnRenamed("model", "baseline")), *t.METRICS)


@query("ml_10_best_on_validation", upto("overall", f"""SELECT split, model, "rows", {METRICS} FROM overall WHERE model = (SELECT model FROM overall WHERE split = 'validation' AND model <> 'baseline_last_value'
 ORDER BY "sMAPE", "MAE", model LIMIT 1)"""))
def best_on_validation(spark, sf):
    metrics = staged(fc.overall_metrics(t.predictions(spark, sf)), "metrics")
    best = fc.best_model(metrics, "validation", [fc.OFFICIAL_BASELINE])
    return t.rounded(fc.metrics_of_best(metrics, best), *t.METRICS)


@query("ml_10_best_epoch", upto("evaluated", f'SELECT epoch, "validation_sMAPE", "validation_MAE" FROM {HISTORY} ORDER BY "validation_sMAPE", "validation_MAE", epoch LIMIT 1'))
def best_epoch(spark, sf):
    return fc.best_epoch(history(spark, sf)).select("epoch", "validation_sMAPE", "validation_MAE")


@query("ml_11_best_reference_on_test", upto("overall", f"SELECT split, model, \"rows\", {METRICS} FROM overall WHERE split = 'test' AND model <> 'baseline_last_value' ORDER BY overall.\"sMAPE\", overall.\"MAE\", model LIMIT 1"))
def best_reference(spark, sf):
    return t.rounded(fc.best_test_reference(fc.overall_metrics(t.predictions(spark, sf))), *t.METRICS)


@query("ml_11_winner_on_test", upto("overall", f"SELECT split, model, \"rows\", {METRICS} FROM overall WHERE split = 'test' ORDER BY overall.\"sMAPE\", model LIMIT 1"))
def winner(spark, sf):
    return t.rounded(fc.test_winner(fc.overall_metrics(t.predictions(spark, sf))), *t.METRICS)


@query("ml_12_target_scaled_and_restored", upto("modeling", "SELECT date, tag, tag_type, round((target_next_count - m) / s, 6) + 0 AS target_next_count_scaled, round(target_next_count, 6) + 0 AS restored FROM modeling, (SELECT avg(target_next_count) AS m, stddev_pop(target_next_count) AS s FROM modeling WHERE split = 'train')"))
def target_scaled(spark, sf):
    rows = t.stored_features(spark, sf).where("modeling_ready")
    scaled = scaling.standardise_target(rows, fc.TARGET)
    moments = scaling.split_moments(rows, fc.TARGET).select(F.struct("mean", "std")).scalar()
    restored = scaling.restore_target(scaled, f"{fc.TARGET}_scaled", moments, "restored")
    return t.rounded(restored.select("date", "tag", "tag_type", f"{fc.TARGET}_scaled", "restored"), f"{fc.TARGET}_scaled", "restored")


@query("ml_13_accuracy_vs_training_time", f"SELECT {_MODEL_NAMES} AS model, true AS timed, true AS bounded, 4 AS models")
def accuracy_vs_time(spark, sf):
    """Each model once, with its time and a test sMAPE between 0 and 200."""
    fitted = _fitted(spark, sf)
    times = ml.training_times(spark, fitted.seconds, "checked", 0).select("model", "train_seconds")
    rows = fc.accuracy_vs_time(fc.overall_metrics(fitted.predictions), times)
    named = rows.select("model", (F.col("train_seconds") > 0).alias("timed"), F.col("sMAPE").between(0, 200).alias("bounded"))
    return named.withColumn("models", rows.agg(F.count(F.lit(1)).cast("int")).scalar())


@query("ml_14_actual_and_predicted_series", upto("evaluated", "SELECT date, target_next_count, round(prediction, 6) + 0 AS prediction FROM evaluated WHERE tag_type = 'hashtag' AND tag = '#click'"))
def series(spark, sf):
    return t.rounded(fc.series_of(fc.scored(t.predictions(spark, sf)), "hashtag", "#click", "baseline_rolling_mean_3"), "prediction")


@query("ml_15_learning_curve", upto("evaluated", f'SELECT epoch, round(train_loss, 4) + 0 AS train_loss, "validation_sMAPE", CAST(NULL AS DOUBLE) AS elapsed_seconds FROM {HISTORY}'))
def learning_curve(spark, sf):
    return t.rounded(fc.learning_curve(history(spark, sf)), "train_loss", digits=4)


# Five models (four learned and the official baseline), four baselines, two splits, two tag types.
_RUN_TABLES = """SELECT "table", CAST(metric_rows AS BIGINT) AS metric_rows, CAST(scored_rows AS BIGINT) AS scored_rows FROM (
 SELECT unnest(['baseline_overall', 'baseline_by_tag', 'baseline_by_type', 'overall', 'by_tag', 'by_type']) AS "table",
 unnest([4 * splits, tags, 4 * splits * types, 5 * splits, tags, 5 * splits * types]) AS metric_rows,
 unnest([4 * n, n_test, 4 * n, 5 * n, n_test, 5 * n]) AS scored_rows
 FROM (SELECT count(DISTINCT split) AS splits, count(DISTINCT tag_type) AS types, count(DISTINCT tag_type || tag) AS tags,
 count(*) AS n, count(CASE WHEN split = 'test' THEN 1 END) AS n_test FROM scored WHERE model = 'baseline_lag_7'))"""


@query("forecast_run_tables", upto("scored", _RUN_TABLES))
def forecast_run(spark, sf):
    """The whole run with all four models: metric rows of every table."""
    run = forecasting.run(t.stored_features(spark, sf), "checked")
    tables = {
        "baseline_overall": run.baseline_overall,
        "baseline_by_tag": run.baseline_by_tag,
        "baseline_by_type": run.baseline_by_type,
        "overall": run.overall,
        "by_tag": run.by_tag,
        "by_type": run.by_type,
    }
    return concat_all(
        [
            df.agg(F.count(F.lit(1)).alias("metric_rows"), F.sum("rows").alias("scored_rows")).withColumn("table", F.lit(name))
            for name, df in tables.items()
        ]
    )


# ---- a longer series: order priorities and states as tags, thousands of dates

_ORDER_COUNTS = """SELECT CAST(o_orderdate AS DATE) AS date, '#' || o_orderpriority AS tag, 'hashtag' AS tag_type, count(*) AS count FROM orders GROUP BY ALL
 UNION ALL SELECT CAST(o_orderdate AS DATE), '$' || o_orderstatus, 'cashtag', count(*) FROM orders GROUP BY ALL"""


def _order_sql(select: str, last: str) -> str:
    """The shared steps from the count table on, over the order counts and longer splits."""
    whole = upto(last, select)
    start = whole.index("summary AS (")
    body = whole[start:].replace("observed_days >= 20", "observed_days >= 60")
    body = body.replace("date_position < 20", "date_position < 1700").replace("date_position < 24", "date_position < 2100")
    return f"WITH counts AS ({_ORDER_COUNTS}),\n{body}"


def _order_features(spark, sf):
    orders = t.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("#"), "o_orderpriority").alias("tag"), F.lit("hashtag").alias("tag_type")),
                F.struct(F.concat(F.lit("$"), "o_orderstatus").alias("tag"), F.lit("cashtag").alias("tag_type")),
            )
        ).alias("t"),
    )
    counts = orders.groupBy("date", "t.tag", "t.tag_type").agg(F.count(F.lit(1)).alias("count"))
    return feature_table(staged(counts, "order-counts"), PanelSettings(train_dates=1700, validation_dates=400))


@query("order_series_features", _order_sql(f"SELECT date, tag, tag_type, count, target_next_count, count_lag_7, {rounded('rolling_mean_7', 'rolling_std_7', 'count_pct_change_1', 'anomaly_z_ready_7')}, split, modeling_ready FROM features", "features"))
def order_features(spark, sf):
    rows = _order_features(spark, sf).select("date", "tag", "tag_type", "count", "target_next_count", "count_lag_7", "rolling_mean_7", "rolling_std_7", "count_pct_change_1", "anomaly_z_ready_7", "split", "modeling_ready")
    return t.rounded(rows, "rolling_mean_7", "rolling_std_7", "count_pct_change_1", "anomaly_z_ready_7")


@query("order_series_baseline_metrics", _order_sql(f'SELECT split, model, "rows", {METRICS} FROM overall', "overall"))
def order_metrics(spark, sf):
    modeling = _order_features(spark, sf).where("modeling_ready")
    long = fc.long_forecasts(fc.baseline_forecasts(modeling), label="model")
    return t.rounded(fc.overall_metrics(long), *t.METRICS)
