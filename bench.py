"""Headline queries on one machine: prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from caudal.catalog import load
from caudal.catalog.domain import closed_panel
from caudal.plans.strategies import direct_forecast
from caudal.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = [
    "consumption_scan", "monthly_panel", "frame_h1", "scores_by_level", "ensemble_scores", "reconciled_forecasts", "check_summary", "change_planta_sku", "eda_series",
    "nowcast_table", "nowcast_global_scores_mes", "expected_rest_of_month", "model_confidence_set", "planner_compare", "planner_summary",
    "tracking_scores", "tracking_rows", "load_merged", "prediction_store_scan",
]


def seconds(run) -> float:
    started = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    times = {name: seconds(lambda name=name: registry[name].run(spark, SF_DIR)) for name in QUERIES}

    def forecast():
        panel = closed_panel(spark, SF_DIR)
        return direct_forecast(panel, panel.last_mi, 1)

    times["forecast_run"] = seconds(forecast)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
