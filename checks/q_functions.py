"""Scalar functions, reshaping, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.registry import query
from checks.sql import JSON_STEPS, TRAIN, VALIDATION, rounded, upto
from tagloom.functions import arithmetic as ar
from tagloom.functions import dates as dt
from tagloom.functions import text as tx
from tagloom.functions.metrics import error_metrics
from tagloom.operators import buckets, corpus, counts, diagnostics as dg, forecasts as fc, quality
from tagloom.operators import ranking as rk
from tagloom.operators import reshape, splits
from tagloom.operators.features import lagged
from tagloom.session import staged
from tagloom.sources.tables import MODELING_COLUMNS

METRICS = rounded("MAE", "RMSE", "sMAPE")
HASHTAGS = r"array_to_string(regexp_extract_all(lower(text), '#[\p{L}\p{N}_]+'), ' ')"
CASHTAGS = r"array_to_string(regexp_extract_all(upper(text), '[$][A-Z]{1,5}'), ' ')"


# ---- strings

@query("str_01_extract_hashtags", upto("tweets", f"SELECT event_id, coalesce({HASHTAGS}, '') AS hashtags FROM tweets"))
def hashtags(spark, sf):
    return t.tweets(spark, sf).select("event_id", F.array_join(tx.extract_hashtags(F.col("text")), " ").alias("hashtags"))


@query("str_02_extract_cashtags", upto("tweets", f"SELECT event_id, coalesce({CASHTAGS}, '') AS cashtags FROM tweets"))
def cashtags(spark, sf):
    return t.tweets(spark, sf).select("event_id", F.array_join(tx.extract_cashtags(F.col("text")), " ").alias("cashtags"))


@query("str_03_hash_label", "SELECT event_id, '#' || lower(upper(event_type)) AS tag FROM events")
def hash_label(spark, sf):
    return t.table(spark, sf, "events").select("event_id", tx.hash_label(F.upper("event_type")).alias("tag"))


_WORDS = """CASE WHEN regexp_full_match(text, ' +') THEN [] ELSE string_split(regexp_replace(text, ' +$', ''), ' ') END"""


@query("str_04_space_tokens", f"SELECT doc_id, len({_WORDS}) AS words, array_to_string({_WORDS}, '|') AS joined FROM documents")
def space_tokens(spark, sf):
    words = tx.space_tokens(F.col("text"))
    return t.table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.array_join(words, "|").alias("joined"))


_TOKENS = r"[w FOR w IN regexp_split_to_array(text, '[ \t\n\r\f]+') IF w <> '']"


@query("str_05_whitespace_tokens", f"SELECT doc_id, len({_TOKENS}) AS words, array_to_string({_TOKENS}, '|') AS joined FROM documents")
def whitespace_tokens(spark, sf):
    words = tx.whitespace_tokens(F.col("text"))
    return t.table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.array_join(words, "|").alias("joined"))


@query("str_06_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%m-%d') AS month_day FROM orders")
def date_format(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", dt.iso_day(F.col("o_orderdate")).alias("day"), dt.month_day(F.col("o_orderdate")).alias("month_day"))


@query("str_07_text_or_unknown", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def text_or_unknown(spark, sf):
    labels = t.table(spark, sf, "labels")
    rows = t.table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.select("doc_id", tx.text_or_unknown(F.col("quality")).alias("quality"))


@query("udf_01_sql_functions", upto("tweets", f"SELECT event_id, coalesce({HASHTAGS}, '') AS hashtags, coalesce({CASHTAGS}, '') AS cashtags FROM tweets"))
def sql_functions(spark, sf):
    tx.register_sql_functions(spark)
    return spark.sql(
        "SELECT event_id, array_join(extract_hashtags(text), ' ') AS hashtags, "
        "array_join(extract_cashtags(text), ' ') AS cashtags FROM {tweets}",
        tweets=t.tweets(spark, sf),
    )


@query("udf_02_metric_row_over_lineitem", "SELECT l_returnflag, count(*) AS \"rows\", round(avg(abs(p - a)), 4) + 0 AS \"MAE\", round(sqrt(avg((p - a) * (p - a))), 4) + 0 AS \"RMSE\", round(avg(CASE WHEN abs(a) + abs(p) = 0 THEN 0 ELSE 200 * abs(p - a) / (abs(a) + abs(p)) END), 4) + 0 AS \"sMAPE\" FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS a, CAST(l_quantity AS DOUBLE) * 1500 AS p FROM lineitem) GROUP BY l_returnflag")
def metrics_over_lineitem(spark, sf):
    guess = F.col("l_quantity").cast("double") * 1500
    rows = t.table(spark, sf, "lineitem").withColumn("guess", guess).groupBy("l_returnflag")
    return t.rounded(rows.agg(*error_metrics("l_extendedprice", "guess")), *t.METRICS, digits=4)


# ---- dates

@query("dt_01_text_to_date", upto("tweets", "SELECT event_id, TRY_CAST(substr(created_at, 1, 10) AS DATE) AS date FROM tweets"))
def text_to_date(spark, sf):
    return t.tweets(spark, sf).select("event_id", dt.to_day(F.col("created_at")).alias("date"))


@query("dt_02_monday_week", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders")
def monday_week(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", dt.week_start(F.col("o_orderdate").cast("date")).cast("date").alias("week"))


@query("dt_03_days_since_epoch", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def epoch_days(spark, sf):
    days = F.unix_date(F.col("o_orderdate").cast("date")).cast("double")
    shifted = F.when(F.col("o_orderstatus") == "F", days + 2e9).otherwise(days)
    return t.table(spark, sf, "orders").select("o_orderkey", dt.day_from_epoch(shifted).alias("date"))


@query("dt_04_day_of_week", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week FROM orders")
def day_of_week(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", dt.monday_zero(F.col("o_orderdate")).alias("day_of_week"))


# ---- arithmetic

@query("mth_01_guarded_division", upto("lagged", "SELECT tag_type, tag, date, CASE WHEN count_lag_1 = 0 THEN 0.0 ELSE round((count - count_lag_1) / count_lag_1, 6) + 0 END AS change FROM lagged"))
def guarded(spark, sf):
    rows = t.panel(spark, sf).select("tag_type", "tag", "date", "count", lagged(1).alias("before"))
    change = ar.change_ratio(F.col("count") - F.col("before"), F.col("before"))
    return t.rounded(rows.select("tag_type", "tag", "date", change.alias("change")), "change")


@query("mth_02_clip_below", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(c_acctbal AS DOUBLE) END AS balance FROM customer")
def clip_below(spark, sf):
    return t.table(spark, sf, "customer").select("c_custkey", ar.at_least(F.col("c_acctbal"), 0.0).alias("balance"))


@query("mth_03_clip_at_quantile", "SELECT event_id, round(least(value, (SELECT quantile_cont(value, 0.98) FROM events)), 6) + 0 AS value FROM events")
def clip_quantile(spark, sf):
    rows = t.table(spark, sf, "events").select("event_id", "value")
    return t.rounded(buckets.clip_at_quantile(rows, "value"), "value")


@query("mth_04_row_errors", upto("rowwise", f"SELECT date, tag, tag_type, model, {rounded('residual', 'abs_error', 'row_smape')} FROM rowwise"))
def row_errors(spark, sf):
    rows = dg.evaluation_rows(fc.scored(t.predictions(spark, sf)))
    return t.rounded(rows.select("date", "tag", "tag_type", "model", "residual", "abs_error", "row_smape"), "residual", "abs_error", "row_smape")


@query("mth_05_conditional_label", upto("positions", f"SELECT date, CASE WHEN date_position < {TRAIN} THEN 'train' WHEN date_position < {TRAIN + VALIDATION} THEN 'validation' ELSE 'test' END AS split FROM positions"))
def labels(spark, sf):
    return splits.split_calendar(t.lazy_counts(spark, sf), TRAIN, VALIDATION).select("date", "split")


def _histogram(source: str, n: int) -> str:
    return (
        f"WITH src AS ({source}), rng AS (SELECT min(x) AS lo, max(x) AS hi FROM src),\n"
        f"placed AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * {n}) AS INTEGER), {n - 1}) AS g, x, lo, (hi - lo) / {n} AS w FROM src, rng WHERE x IS NOT NULL),\n"
        f"fixed AS (SELECT g - CASE WHEN x < lo + g * w THEN 1 ELSE 0 END + CASE WHEN x >= lo + (g + 1) * w AND g < {n - 1} THEN 1 ELSE 0 END AS bin FROM placed)\n"
        f"SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / {n}, 6) + 0 AS lo, round(CASE WHEN i = {n - 1} THEN hi ELSE lo + (i + 1) * (hi - lo) / {n} END, 6) + 0 AS hi, "
        f"(SELECT count(*) FROM fixed WHERE bin = i) AS \"rows\" FROM range({n}) r(i), rng"
    )


@query("mth_06_histogram_30_bins", _histogram("SELECT least(value, (SELECT quantile_cont(value, 0.98) FROM events)) AS x FROM events", 30))
def histogram_30(spark, sf):
    clipped = buckets.clip_at_quantile(t.table(spark, sf, "events").select("value"), "value")
    return t.rounded(buckets.histogram(clipped, "value", 30), "lo", "hi")


@query("mth_06_residual_histogram", "WITH " + upto("evaluated", "").removeprefix("WITH ").rstrip() + ",\n" + _histogram("SELECT residual AS x FROM evaluated", 35).removeprefix("WITH "))
def histogram_35(spark, sf):
    return t.rounded(buckets.histogram(t.evaluated(spark, sf), "residual", 35), "lo", "hi")


@query("mth_07_quantile_buckets", "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]))) AS edges FROM events), b AS (SELECT value, edges, greatest(len([x FOR x IN edges IF x < value]) - 1, 0) AS bucket FROM events, e) SELECT bucket, count(*) AS \"rows\", round(list_extract(edges, CAST(bucket + 1 AS INTEGER)), 6) + 0 AS lo, round(list_extract(edges, CAST(bucket + 2 AS INTEGER)), 6) + 0 AS hi FROM b GROUP BY bucket, edges")
def quantile_buckets(spark, sf):
    rows = buckets.quantile_buckets(t.table(spark, sf, "events").select("value"), "value")
    grouped = rows.groupBy(F.col("bucket").cast("long").alias("bucket"), F.col("bucket_bounds.lo").alias("lo"), F.col("bucket_bounds.hi").alias("hi"))
    return t.rounded(grouped.agg(F.count(F.lit(1)).alias("rows")), "lo", "hi")


@query("mth_08_equal_width_buckets", "WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT value, CASE WHEN value <= lo + (hi - lo) / 4 THEN 0 WHEN value <= lo + 2 * (hi - lo) / 4 THEN 1 WHEN value <= lo + 3 * (hi - lo) / 4 THEN 2 ELSE 3 END AS bucket, lo, hi FROM events, r) SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS \"rows\", round(CASE WHEN bucket = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + bucket * (hi - lo) / 4 END, 6) + 0 AS lo, round(lo + (bucket + 1) * (hi - lo) / 4, 6) + 0 AS hi FROM b GROUP BY bucket, lo, hi")
def equal_width(spark, sf):
    rows = buckets.equal_width_buckets(t.table(spark, sf, "events").select("value"), "value")
    grouped = rows.groupBy(F.col("bucket").cast("long").alias("bucket"), F.col("bucket_bounds.lo").alias("lo"), F.col("bucket_bounds.hi").alias("hi"))
    return t.rounded(grouped.agg(F.count(F.lit(1)).alias("rows")), "lo", "hi")


@query("mth_09_rounding", "SELECT event_type, round(avg(value), 2) + 0 AS mean_value FROM events GROUP BY event_type")
def rounding(spark, sf):
    means = t.table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean_value"))
    return t.rounded(means, "mean_value", digits=2)


# ---- arrays, maps, JSON

@query("arr_01_explode_tags", upto("hashtags", "SELECT date, tag, count(*) AS n FROM hashtags GROUP BY date, tag"))
def explode_tags(spark, sf):
    rows = counts.exploded_tags(t.cleaned(spark, sf), "hashtags", "date")
    return rows.groupBy("date", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("arr_02_flat_map_words", f"SELECT doc_id, word FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents)")
def flat_map(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.explode(tx.space_tokens(F.col("text"))).alias("word"))


@query("arr_03_concatenated_urls", JSON_STEPS + "SELECT event_id, token FROM raw_tokens WHERE kind = 'url'")
def concatenated_urls(spark, sf):
    rows = corpus.tweet_entities(t.json_tweets(spark, sf), keep=("event_id",))
    return rows.select("event_id", F.explode("urls").alias("token"))


@query("arr_04_evenly_spaced_dates", "WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)) SELECT CAST(i AS INTEGER) AS tick, CAST(position AS INTEGER) AS position, date FROM range(8) r(i) JOIN d ON position = CAST(floor(i * (n - 1) / 7) AS BIGINT)")
def spaced_dates(spark, sf):
    dates = t.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return reshape.evenly_spaced_dates(dates, 8)


@query("map_01_model_to_seconds", upto("long", "SELECT model, CAST(count(*) AS DOUBLE) AS train_seconds FROM long WHERE split = 'train' GROUP BY model"))
def model_map(spark, sf):
    rows = t.predictions(spark, sf).where("split = 'train'").groupBy("model").agg(F.count(F.lit(1)).cast("double").alias("train_seconds"))
    mapped = reshape.rows_to_map(rows, "model", "train_seconds")
    return mapped.select(F.explode("map").alias("model", "train_seconds"))


@query("jsn_01_entities_of_tweet", "SELECT event_id, '#' || lower(js ->> '$.entities.hashtags[0].text') AS hashtags, concat_ws(' ', js ->> '$.entities.urls[0].expanded_url', js ->> '$.entities.media[0].expanded_url') AS urls FROM (" + upto("json_tweets", "SELECT event_id, js FROM json_tweets") + ")")
def entities(spark, sf):
    rows = corpus.tweet_entities(t.json_tweets(spark, sf), keep=("event_id",)).where("position = 0")
    return rows.select("event_id", F.array_join("hashtags", " ").alias("hashtags"), F.array_join("urls", " ").alias("urls"))


@query("jsn_02_null_tolerant_access", "SELECT event_type, count(*) AS tweets, CAST(count(CASE WHEN event_type <> 'click' THEN 1 END) AS BIGINT) AS with_media FROM events GROUP BY event_type")
def null_tolerant(spark, sf):
    tweets = t.table(spark, sf, "events").selectExpr("event_id", "event_type", f"{t.TWEET_JSON} AS json")
    rows = corpus.tweet_entities(tweets, keep=("event_type",)).where("position = 0")
    media = F.count(F.when(F.array_join("urls", " ").contains("m.test"), 1))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("tweets"), media.alias("with_media"))


@query("jsn_03_nested_tweets", JSON_STEPS + "SELECT event_id, count(*) AS blocks FROM nodes WHERE json_type(js, '$.entities') = 'OBJECT' GROUP BY event_id")
def nested(spark, sf):
    rows = corpus.entity_rows(t.json_tweets(spark, sf), keep=("event_id",))
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("blocks"))


@query("jsn_03_tokens_of_nested_tweets", JSON_STEPS + "SELECT kind, token, count(*) AS n, count(DISTINCT event_id) AS tweets FROM raw_tokens GROUP BY kind, token")
def nested_tokens(spark, sf):
    return t.tokens(spark, sf).groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("tweets"))


# Chains of up to 29 nested tweets, and of 1,200 now and then: deeper than JSON parsers go by themselves.
_CHAIN_DEPTH = "CASE WHEN event_id % 997 = 5 THEN 1200 ELSE event_id % 30 END"
_CHAIN_JSON = """concat(repeat('{"entities":{"hashtags":[{"text":"Link"}],"urls":[{"expanded_url":"u}{"}]},"retweeted_status":', CAST(n AS INT)),
 '{"entities":{"hashtags":[{"text":"End"}]}}', repeat('}', CAST(n AS INT)))"""


@query("jsn_03_chains_of_tweets", f"""SELECT n, kind, token, CAST(sum(times) AS BIGINT) AS tokens, count(*) AS tweets FROM (
 SELECT n, unnest(['hashtag', 'url', 'hashtag']) AS kind, unnest(['#link', 'u}}{{', '#end']) AS token, unnest([n, n, 1]) AS times
 FROM (SELECT {_CHAIN_DEPTH} AS n FROM events)) WHERE times > 0 GROUP BY n, kind, token""")
def chains(spark, sf):
    tweets = t.table(spark, sf, "events").selectExpr("event_id", f"{_CHAIN_DEPTH} AS n").selectExpr("event_id", "n", f"{_CHAIN_JSON} AS json")
    tokens = corpus.tweet_tokens(tweets, keep=("event_id", "n"))
    return tokens.groupBy("n", "kind", "token").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("event_id").alias("tweets"))


# ---- reshaping

@query("pvt_01_wide_to_long", upto("long", "SELECT date, tag, tag_type, target_next_count, split, model AS baseline, round(prediction, 6) + 0 AS prediction FROM long"))
def wide_to_long(spark, sf):
    return t.rounded(fc.long_forecasts(t.baselines(spark, sf)), "prediction")


_TOP5 = "(SELECT tag, sum(count) AS total FROM daily_h WHERE date IS NOT NULL GROUP BY tag ORDER BY total DESC, tag LIMIT 5)"


def _names(rows, k):
    """The top k tags become column names; k bounds what comes to the driver."""
    top = rk.top_k(counts.totals_by(rows, "tag", name="total"), k, [F.desc("total"), "tag"])
    return [row["tag"] for row in top.collect()]


@query("pvt_02_pivot_date_by_tag", upto("daily_h", f"SELECT d.date, p.tag, CAST(coalesce(c.count, 0) AS DOUBLE) AS count FROM {_TOP5} p CROSS JOIN (SELECT DISTINCT date FROM daily_h WHERE date IS NOT NULL AND tag IN (SELECT tag FROM {_TOP5})) d LEFT JOIN daily_h c ON c.date = d.date AND c.tag = p.tag"))
def pivot_dates(spark, sf):
    rows = staged(t.daily(spark, sf).where("date is not null"), "daily")
    names = _names(rows, 5)
    kept = rows.where(F.col("tag").isin(names))
    wide = reshape.pivot_values(kept, ["date"], "tag", F.avg("count"), names).fillna(0.0)
    return wide.unpivot(["date"], names, "tag", "count")


_TOP10W = "(SELECT tag, sum(count) AS total FROM weekly_h WHERE week IS NOT NULL GROUP BY tag ORDER BY total DESC, tag LIMIT 10)"


@query("pvt_03_pivot_tag_by_week", upto("weekly_h", f"SELECT p.tag, strftime(w.week, '%Y-%m-%d') AS week, CAST(coalesce(c.count, 0) AS DOUBLE) AS count FROM {_TOP10W} p CROSS JOIN (SELECT DISTINCT week FROM weekly_h WHERE week IS NOT NULL) w LEFT JOIN weekly_h c ON c.week = w.week AND c.tag = p.tag"))
def pivot_weeks(spark, sf):
    rows = counts.weekly_counts(t.cleaned(spark, sf)).where("week is not null")
    rows = staged(rows.withColumn("week", dt.iso_day(F.col("week"))), "weekly")
    top = rk.top_k(counts.totals_by(rows, "tag", name="total"), 10, [F.desc("total"), "tag"])
    weeks = reshape.known_values(rows, "week", 4000)
    wide = reshape.pivot_values(rk.membership(rows, top, ["tag"]), ["tag"], "week", F.avg("count"), weeks).fillna(0.0)
    return wide.unpivot(["tag"], weeks, "week", "count")


@query("pvt_04_pivot_model_by_split", upto("overall", 'SELECT model, round(max(CASE WHEN split = \'validation\' THEN "sMAPE" END), 6) + 0 AS validation, round(max(CASE WHEN split = \'test\' THEN "sMAPE" END), 6) + 0 AS test FROM overall GROUP BY model'))
def pivot_splits(spark, sf):
    rows = fc.overall_metrics(t.predictions(spark, sf))
    wide = reshape.pivot_values(rows, ["model"], "split", F.max("sMAPE"), ["validation", "test"])
    return t.rounded(wide.orderBy("test", "model"), "validation", "test")


@query("pvt_05_pivot_type_by_model", upto("by_type", 'SELECT tag_type, round(max(CASE WHEN model = \'baseline_last_value\' THEN "sMAPE" END), 6) + 0 AS baseline_last_value, round(max(CASE WHEN model = \'baseline_lag_7\' THEN "sMAPE" END), 6) + 0 AS baseline_lag_7 FROM by_type WHERE split = \'test\' GROUP BY tag_type'))
def pivot_models(spark, sf):
    rows = fc.metrics_by_type(t.predictions(spark, sf)).where("split = 'test'")
    wide = reshape.pivot_values(rows, ["tag_type"], "model", F.max("sMAPE"), ["baseline_last_value", "baseline_lag_7"])
    return t.rounded(wide, "baseline_last_value", "baseline_lag_7")


_TOP12 = "(SELECT tag_type, tag, sum(actual) AS volume FROM evaluated GROUP BY tag_type, tag ORDER BY volume DESC, tag_type, tag LIMIT 12)"


@query("pvt_06_error_heat_map", upto("evaluated", f"SELECT e.tag_type || ': ' || e.tag AS tag_label, volume, strftime(date, '%Y-%m-%d') AS date, round(avg(row_smape), 6) + 0 AS row_smape FROM evaluated e JOIN {_TOP12} p ON e.tag_type = p.tag_type AND e.tag = p.tag GROUP BY e.tag_type, e.tag, volume, date"))
def heat_map(spark, sf):
    wide = dg.error_heat_map(t.evaluated(spark, sf))
    dates = [c for c in wide.columns if c not in ("tag_label", "volume")]
    return t.rounded(wide.unpivot(["tag_label", "volume"], dates, "date", "row_smape"), "row_smape")


# ---- data quality

@query("dq_01_required_columns", upto("modeling", "SELECT count(*) AS \"rows\" FROM modeling"))
def required_columns(spark, sf):
    return quality.row_total(quality.require_columns(t.modeling(spark, sf), MODELING_COLUMNS))


@query("dq_02_not_empty", upto("features", "SELECT count(*) > 0 AS has_rows, count(CASE WHEN split = 'test' THEN 1 END) > 0 AS has_test, count(CASE WHEN split = 'dev' THEN 1 END) > 0 AS has_dev, count(CAST(NULL AS DOUBLE)) = 0 AS no_values FROM features"))
def not_empty(spark, sf):
    rows = t.stored_features(spark, sf).withColumn("nothing", F.lit(None).cast("double"))
    quality.require_rows(rows, "feature table")
    return quality.row_total(rows).select(
        (F.col("rows") > 0).alias("has_rows"),
        F.lit(quality.has_rows(rows, "split = 'test'")).alias("has_test"),
        F.lit(quality.has_rows(rows, "split = 'dev'")).alias("has_dev"),
        F.lit(quality.all_null(rows, "nothing")).alias("no_values"),
    )


@query("dq_03_expected_rows_per_split", upto("modeling", "SELECT split, actual, expected FROM (SELECT split, count(*) AS actual, CAST(CASE split WHEN 'train' THEN 390 WHEN 'test' THEN 1 ELSE 0 END AS BIGINT) AS expected FROM modeling GROUP BY split UNION ALL SELECT 'holdout', 0, 5) WHERE actual <> expected"))
def expected_rows(spark, sf):
    return quality.count_violations(t.modeling(spark, sf), "split", {"train": 390, "test": 1, "holdout": 5})


@query("dq_03_expected_tags_per_type", upto("selected", "SELECT tag_type, count(DISTINCT tag) AS actual, CAST(16 AS BIGINT) AS expected FROM selected GROUP BY tag_type"))
def expected_tags(spark, sf):
    return quality.distinct_count_violations(t.selected(t.lazy_counts(spark, sf)), "tag_type", "tag", {"hashtag": 16, "cashtag": 16})


@query("dq_04_duplicate_keys", "SELECT user_id, event_type, day, count(*) AS copies FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY user_id, event_type, day HAVING count(*) > 1")
def duplicates(spark, sf):
    rows = t.table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    return quality.duplicate_keys(rows, ["user_id", "event_type", "day"])


@query("dq_05_target_close_to_next_count", upto("lagged", "SELECT tag_type, count(*) AS bad FROM lagged WHERE target_next_count * 1.0001 - target_next_count > 1e-8 + 1e-5 * target_next_count GROUP BY tag_type"))
def target_close(spark, sf):
    rows = t.features(spark, sf).withColumn("target_next_count", F.col("target_next_count") * 1.0001)
    return quality.target_mismatches(rows).groupBy("tag_type").agg(F.count(F.lit(1)).alias("bad"))


@query("dq_06_distinct_dates", upto("spine", "SELECT count(*) AS distinct_values FROM spine"))
def distinct_dates(spark, sf):
    return quality.distinct_values(t.features(spark, sf), "date")


@query("dq_07_prediction_row_count", upto("scored", "SELECT count(*) AS \"rows\" FROM scored"))
def prediction_rows(spark, sf):
    predictions = fc.scored(t.stored_predictions(spark, sf))
    one_model = predictions.where("model = 'baseline_lag_7'").count()
    quality.require_row_total(predictions, one_model * len(fc.BASELINES), "predictions")
    return quality.row_total(predictions)
