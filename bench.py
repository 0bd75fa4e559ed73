"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload.queries  # noqa: E402,F401
from shelfcast.session import build_session  # noqa: E402
from workload.registry import QUERIES  # noqa: E402

HEADLINE = (
    "weekly_sales_fact",
    "enriched_fact",
    "naive_wape_worst10",
    "lag_rolling_features",
    "published_profile",
    "baseline_forecasts",
    "league_table",
    "best_model_wins",
    "sales_kpis",
    "sales_boxplot_by_type",
    "describe_fact",
    "resample_month",
    "dept_outliers",
    "outlier_causes",
    "factor_ttest",
    "inventory_impact",
    "improvement_potential",
    "summary_report",
    "arima_forecast",
    "trend_season_forecast",
    "gbt_forecast",
    "hybrid_results",
    "full_league_table",
)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the engine and the Python workers before the clock runs.
    QUERIES["store_dimension"](spark, base).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall-clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(base.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
