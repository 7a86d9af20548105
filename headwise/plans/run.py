"""Run the analytics steps over a data folder, one after the other, with a run log."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from headwise.operators.rollups import LOG_SCHEMA
from headwise.plans.frames import Layer
from headwise.sources import store

ANALYTICS_STEPS = (
    "route_metrics", "stop_metrics", "daily_demand", "anomalies", "overcrowding_events", "persistent_overcrowding",
    "underutilization", "bunching_events", "quality_days", "alerts",
)


def run_steps(
    spark: SparkSession, steps: Mapping[str, Callable[[], DataFrame]], save: Callable[[str, DataFrame], DataFrame],
    skip: Sequence[str] = (), component: str = "analytics",
) -> DataFrame:
    """Build and save every step; a failing step is logged and the others still run."""
    log = []
    for name, build in steps.items():
        started, stamp = time.perf_counter(), datetime.now(timezone.utc).replace(tzinfo=None)
        status, details = "skipped", ""
        if name not in skip:
            try:
                status, details = "ok", f"rows={save(name, build()).count()}"
            except Exception as e:  # one broken step must not stop the run
                status, details = "failed", f"{type(e).__name__}: {e}"
        log.append((stamp, f"{component}:{name}", component, status, details, (time.perf_counter() - started) * 1000))
    return spark.createDataFrame(log, LOG_SCHEMA)


def run_all(spark: SparkSession, root: str, base: str, skip: Sequence[str] = ()) -> DataFrame:
    """All analytics tables of a folder, saved under ``base``; returns the run log."""
    layer = Layer(spark, root)
    steps = {name: (lambda n=name: layer[n]) for name in ANALYTICS_STEPS}
    return run_steps(spark, steps, lambda name, df: store.save(df, base, name), skip)
