"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINES = (
    "kpi_summary", "kpi_trend_daily", "kpi_trend_weekly", "kpi_trend_monthly", "spend_efficiency", "funnel_summary",
    "funnel_by_source", "context_metrics", "account_summary", "pct_rank_avg", "portfolio_kpis", "exact_quantiles",
    "mix_features", "channel_contribution", "forecast_seasonal", "forecast_trees", "churn_score", "detect_anomalies",
    "run_all_checks", "adstock", "scale_to_total", "share_of_total", "report_fields",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = build_session(
        "tidemark-bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
        spark__sql__shuffle__partitions="8" if cpus == "*" else str(cpus), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["win_rate"](spark, folder).collect()  # start the JVM's work threads
    warm, cold = {}, {}
    for times in (cold, warm):
        for name in HEADLINES:
            started = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
