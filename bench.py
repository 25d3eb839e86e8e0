"""Time the headline queries and print one JSON line.

Each query is built and run to the end once to warm the JVM and then timed.
``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  ``fit_seconds``
are the training times of the pooled models alone, the figures a run reports.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from checks import tables  # noqa: E402
from checks.compare import local_session  # noqa: E402
from tagloom.operators.models import MODEL_CONFIGS, fit_models  # noqa: E402

HEADLINE = (
    "set_04_distinct_tweets",
    "set_04_dedupe_by_text",
    "agg_03_daily_hashtag_counts",
    "agg_05_weekly_hashtag_counts",
    "srt_03_top_10_tags",
    "agg_01_word_count",
    "agg_02_whitespace_word_count",
    "agg_07_token_totals",
    "jsn_03_tokens_of_nested_tweets",
    "win_10_top_n_per_type",
    "join_03_zero_filled_panel",
    "win_all_feature_columns",
    "order_series_features",
    "agg_20_all_metrics_in_one_pass",
    "agg_26_exact_quantiles",
    "pvt_06_error_heat_map",
    "ml_02_impute_and_standardise",
)


def run(name: str, spark, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    seconds = {}
    for name in HEADLINE:
        run(name, spark, sf)
        seconds[name] = round(run(name, spark, sf), 3)
    modeling = tables.stored_features(spark, sf).where("modeling_ready")
    fit_models(modeling, MODEL_CONFIGS[:2], workers=1)
    fits = {name: round(s, 3) for name, s in fit_models(modeling, workers=1).seconds.items()}
    scale = re.search(r"sf([0-9.]+)", sf)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "fit_seconds": fits,
                "sf": float(scale.group(1)) if scale else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
