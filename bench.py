"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registry.queries import QUERIES  # noqa: E402
from registry.session import local_session  # noqa: E402

HEADLINE = [
    "normalize_arrivals",
    "dedupe_arrivals",
    "history_split",
    "quantile_linear",
    "quantile_nearest",
    "iqr_split",
    "sla_stats",
    "arrival_profile_short",
    "arrival_profile_long",
    "ticker_profile",
    "rollup_fund_client",
    "volume_curve_5min_keep",
    "volume_curve_1min_long",
    "bin_history",
    "bin_forecast",
    "xmr_limits",
    "error_summary_client",
    "alert_summary",
    "prediction_residuals",
    "signed_errors_ticker",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # One untimed query starts the workers and reads the file footers.
    QUERIES["bin_history"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
