"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from headwise.plans.catalog import load
from headwise.session import build_session

HEADLINE = (
    "A06_route_metrics_ranked", "A10_stop_bottlenecks", "A12_daily_demand", "A16_demand_anomalies", "A18_event_impact",
    "A19_zone_flow", "A22_overcrowding_events", "A25_bunching_events", "A27_passenger_segmentation",
    "A32_service_level", "A35_route_reliability_profile", "A36_band_punctuality_and_load", "C26_clean_trips",
    "C26_clean_tickets", "D10_all_alerts", "F04_demand_features", "F10_calendar_window_stats",
    "F12_prior_stats_route", "F19_trip_history_frame", "F21_delay_features", "J03_trip_facts", "J04_stop_facts",
    "K03_detailed_comparison", "R09_all_recommendations", "V11_validate_layer",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog[name].build(spark, root).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("A12_daily_demand")  # start the JVM's compiler and the file caches
    times = {}
    for name in names:
        first = run(name)
        times[name] = round(min(first, run(name)), 3)
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root)}))
    spark.stop()


if __name__ == "__main__":
    main()
