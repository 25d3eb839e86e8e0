"""Shared SQL: the same derived tables, written independently for the check engine."""

from __future__ import annotations

from checks.derive import CREATED_AT, TWEET_JSON, TWEET_TEXT

START, END = "2024-01-01", "2024-01-30"
TOP_N, MIN_DAYS, TRAIN, VALIDATION = 15, 20, 20, 4

_W = "PARTITION BY tag_type, tag ORDER BY date"


def _roll(fn: str, n: int, of: str = "count") -> str:
    frame = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) {frame} = {n} THEN {fn}({of}) {frame} END"


STEPS: dict[str, str] = {
    "tweets": f"SELECT event_id, {CREATED_AT} AS created_at, {TWEET_TEXT} AS text FROM events",
    "cleaned": """SELECT text, min(TRY_CAST(substr(created_at, 1, 10) AS DATE)) AS date
 FROM tweets WHERE text IS NOT NULL GROUP BY text""",
    "hashtags": r"SELECT date, unnest(regexp_extract_all(lower(text), '#[\p{L}\p{N}_]+')) AS tag FROM cleaned",
    "cashtags": r"SELECT date, unnest(regexp_extract_all(upper(text), '[$][A-Z]{1,5}')) AS tag FROM cleaned",
    "daily_h": "SELECT date, tag, count(*) AS count FROM hashtags GROUP BY date, tag",
    "daily_c": "SELECT date, tag, count(*) AS count FROM cashtags GROUP BY date, tag",
    "weekly_h": "SELECT CAST(date_trunc('week', date) AS DATE) AS week, tag, count(*) AS count FROM hashtags GROUP BY 1, 2",
    "weekly_c": "SELECT CAST(date_trunc('week', date) AS DATE) AS week, tag, count(*) AS count FROM cashtags GROUP BY 1, 2",
    "counts": f"""SELECT date, tag, 'hashtag' AS tag_type, count FROM daily_h WHERE date BETWEEN DATE '{START}' AND DATE '{END}'
 UNION ALL SELECT date, tag, 'cashtag' AS tag_type, count FROM daily_c WHERE date BETWEEN DATE '{START}' AND DATE '{END}'""",
    "summary": """SELECT tag_type, tag, CAST(sum(count) AS BIGINT) AS total_count, count(DISTINCT date) AS observed_days
 FROM counts GROUP BY tag_type, tag""",
    "selected": f"""SELECT tag_type, tag, total_count, observed_days FROM (SELECT *, row_number() OVER
 (PARTITION BY tag_type ORDER BY total_count DESC, observed_days DESC, tag) AS rk FROM summary WHERE observed_days >= {MIN_DAYS})
 WHERE rk <= {TOP_N}""",
    "spine": "SELECT DISTINCT date FROM counts",
    "positions": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_position FROM spine",
    "panel": """SELECT d.date, s.tag, s.tag_type, coalesce(c.count, 0) AS count FROM selected s CROSS JOIN spine d
 LEFT JOIN counts c ON c.tag_type = s.tag_type AND c.tag = s.tag AND c.date = d.date""",
    "lagged": f"""SELECT *, CAST(lead(count) OVER ({_W}) AS DOUBLE) AS target_next_count,
 {', '.join(f'CAST(lag(count, {k}) OVER ({_W}) AS DOUBLE) AS count_lag_{k}' for k in (1, 2, 3, 7))},
 {', '.join(f'{_roll(fn, n)} AS rolling_{name}_{n}' for n in (3, 7) for fn, name in (('avg', 'mean'), ('stddev_samp', 'std')))},
 row_number() OVER ({_W}) - 1 AS day_index FROM panel""",
    "features": f"""SELECT l.*, count - count_lag_1 AS count_diff_1,
 CASE WHEN count_lag_1 = 0 THEN 0.0 ELSE (count - count_lag_1) / count_lag_1 END AS count_pct_change_1,
 isodow(l.date) - 1 AS day_of_week, rolling_mean_7 AS anomaly_trailing_mean_7, rolling_std_7 AS anomaly_trailing_std_7,
 count - rolling_mean_7 AS anomaly_deviation_7,
 CASE WHEN rolling_std_7 > 0 THEN (count - rolling_mean_7) / rolling_std_7 END AS anomaly_z_ready_7,
 CASE WHEN date_position < {TRAIN} THEN 'train' WHEN date_position < {TRAIN + VALIDATION} THEN 'validation' ELSE 'test' END AS split,
 target_next_count IS NOT NULL AND count_lag_7 IS NOT NULL AND rolling_std_7 IS NOT NULL AS modeling_ready
 FROM lagged l JOIN positions p ON l.date = p.date""",
    "modeling": "SELECT * FROM features WHERE modeling_ready",
    "baselines": """SELECT date, tag, tag_type, count, target_next_count, split, CAST(count AS DOUBLE) AS baseline_last_value,
 rolling_mean_3 AS baseline_rolling_mean_3, rolling_mean_7 AS baseline_rolling_mean_7, count_lag_7 AS baseline_lag_7 FROM modeling""",
    "long": """SELECT date, tag, tag_type, target_next_count, split, model, prediction FROM baselines
 UNPIVOT (prediction FOR model IN (baseline_last_value, baseline_rolling_mean_3, baseline_rolling_mean_7, baseline_lag_7))""",
    "scored": "SELECT * FROM long WHERE split IN ('validation', 'test')",
    "rowwise": """SELECT *, target_next_count AS actual, prediction - target_next_count AS residual,
 abs(prediction - target_next_count) AS abs_error,
 CASE WHEN abs(prediction) + abs(target_next_count) = 0 THEN 0.0
 ELSE 200.0 * abs(prediction - target_next_count) / (abs(prediction) + abs(target_next_count)) END AS row_smape FROM scored""",
    "overall": "SELECT split, model, count(*) AS \"rows\", avg(abs_error) AS \"MAE\", sqrt(avg(residual * residual)) AS \"RMSE\", avg(row_smape) AS \"sMAPE\" FROM rowwise GROUP BY split, model",
    "by_type": "SELECT split, tag_type, model, count(*) AS \"rows\", avg(abs_error) AS \"MAE\", sqrt(avg(residual * residual)) AS \"RMSE\", avg(row_smape) AS \"sMAPE\" FROM rowwise GROUP BY split, tag_type, model",
    "by_tag": "SELECT split, tag_type, tag, model, count(*) AS \"rows\", avg(abs_error) AS \"MAE\", sqrt(avg(residual * residual)) AS \"RMSE\", avg(row_smape) AS \"sMAPE\" FROM rowwise GROUP BY split, tag_type, tag, model",
    # One model's rows, as the diagnostics read them.
    "evaluated": "SELECT * FROM rowwise WHERE model = 'baseline_rolling_mean_3'",
    "json_tweets": f"SELECT event_id, CAST({TWEET_JSON} AS JSON) AS js FROM events",
}

JSON_STEPS = f"""WITH RECURSIVE json_tweets AS ({STEPS['json_tweets']}),
nodes AS (SELECT event_id, js FROM json_tweets UNION ALL
 SELECT event_id, child AS js FROM (SELECT event_id, unnest([js->'retweeted_status', js->'quoted_status']) AS child FROM nodes)
 WHERE child IS NOT NULL AND json_type(child) = 'OBJECT'),
raw_tokens AS (SELECT event_id, 'hashtag' AS kind, '#' || lower(t) AS token
 FROM (SELECT event_id, unnest(json_extract_string(js, '$.entities.hashtags[*].text')) AS t FROM nodes) WHERE t <> ''
 UNION ALL SELECT event_id, 'url', t
 FROM (SELECT event_id, unnest(json_extract_string(js, '$.entities.urls[*].expanded_url')) AS t FROM nodes) WHERE t <> ''
 UNION ALL SELECT event_id, 'url', t
 FROM (SELECT event_id, unnest(json_extract_string(js, '$.entities.media[*].expanded_url')) AS t FROM nodes) WHERE t <> '')
"""


def upto(last: str, select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` over the shared tables up to and including ``last``."""
    parts = []
    for name, body in STEPS.items():
        parts.append(f"{name} AS ({body})")
        if name == last:
            break
    parts += [f"{name} AS ({body})" for name, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


def rounded(*columns: str, digits: int = 6) -> str:
    """``round(x, 6) + 0`` under the same names; the addition removes negative zeros."""
    return ", ".join(f'round("{c}", {digits}) + 0 AS "{c}"' for c in columns)
