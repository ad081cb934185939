"""Headline queries at one scale; prints one JSON line.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "observed_severity_counts", "standardized_index_scales", "station_index", "polygon_index", "zonal_mean",
    "trend_statistics", "densified_series", "overview_counts", "kpi", "map_snapshot", "effective_month",
    "latest_per_day", "predictor_table", "helper_imputation", "interval_spreads", "realized_feedback", "text_repair",
    "forecast_window_regression",
)


def main() -> None:
    from parchline.session import local_session
    from parchline.workloads import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "16g")
    # One untimed query starts the JVM's code paths.
    QUERIES["overview_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
