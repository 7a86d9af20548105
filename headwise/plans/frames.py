"""Composed frames that several queries share, built from the star tables."""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions.scans import micros_chunk
from headwise.operators import aggregates as A
from headwise.operators.alerts import build_alerts
from headwise.operators import features as Fe
from headwise.operators import joins as J
from headwise.session import materialise
from headwise.plans.stored import stored
from headwise.sources import star

NOW = "2024-02-01T00:00:00"
# The analytics tables the decision operators read, the longest to build first.
DECISION_TABLES = (
    "stop_metrics", "route_metrics", "anomalies", "bunching_events", "persistent_overcrowding", "overcrowding_events",
    "quality_days", "underutilization",
)
PROFILE_TABLES = ("stop_metrics", "route_metrics", "daily_demand", "bunching_events", "overcrowding_events", "quality_days")


def route_dim(spark: SparkSession, root: str) -> DataFrame:
    return star.routes(spark, root).select("route_id", "category", "length_km", "route_name")


def trip_facts(spark: SparkSession, root: str) -> DataFrame:
    return J.trip_facts(star.trips(spark, root), star.routes(spark, root), star.vehicles(spark, root))


def route_metrics(spark: SparkSession, root: str) -> DataFrame:
    return A.route_metrics(
        star.trips(spark, root), star.raw_rides(spark, root), route_dim(spark, root), keep=materialise
    )


def stop_metrics(spark: SparkSession, root: str) -> DataFrame:
    return A.stop_metrics(star.raw_stop_visits(spark, root), star.stops(spark, root), keep=materialise)


def daily_demand(spark: SparkSession, root: str) -> DataFrame:
    return A.daily_demand(star.raw_rides(spark, root))


def route_zones(spark: SparkSession, root: str) -> DataFrame:
    return J.route_zones(star.route_stops(spark, root), star.stops(spark, root))


def history(spark: SparkSession, root: str, keep: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    return Fe.history_frame(
        star.trip_sources(spark, root),
        star.trip_columns,
        star.routes(spark, root),
        star.vehicles(spark, root),
        star.trip_calendar(spark, root),
        route_zones(spark, root),
        star.trip_events(spark, root),
        micros_chunk("us"),
        keep,
    )


def demand_frame(spark: SparkSession, root: str) -> DataFrame:
    """Demand cells with prediction-time-safe context: events, route attributes, calendar lags and windows."""
    d = Fe.demand_cells(star.raw_rides(spark, root)).select("route_id", "date", "time_band", "boardings")
    d = J.event_multiplier(d, route_zones(spark, root), star.ride_events(spark, root))
    d = Fe.static_attributes(d, star.routes(spark, root))
    keys = ["route_id", "time_band"]
    d = Fe.calendar_windows(Fe.calendar_lags(d, keys, "date", "boardings"), keys, "date", "boardings")
    return d.select("*", F.weekday("date").alias("weekday"), F.month("date").alias("month"))


class Layer(dict):
    """The analytics tables of a data folder, each built and written once on first use.

    Decision operators read several of these tables several times; reading the written tables keeps every consumer a
    scan of a small aggregate instead of a repeat of the fact-table work. Tables are kept by their inputs (``stored``), so
    a later layer over the same files reads what an earlier one wrote.
    """

    def __init__(self, spark: SparkSession, root: str, *names: str):
        super().__init__()
        self._spark, self._root = spark, root
        self._locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
        self.prepare(*names)

    def prepare(self, *names: str) -> None:
        """Build several independent tables as concurrent Spark jobs."""
        if names:
            with ThreadPoolExecutor(max_workers=4) as pool:
                list(pool.map(self.__getitem__, names))

    def __missing__(self, name: str) -> DataFrame:
        spark, root = self._spark, self._root
        with self._locks[name]:
            if name in self:  # another thread built it while this one waited
                return self.get(name)
            if name == "stop_facts":
                df = star.stop_facts(spark, root)
            else:
                df = stored(spark, root, name, lambda: self._build(name), (S.DEFAULTS, NOW))
            self[name] = df
            return df

    def _build(self, name: str) -> DataFrame:
        spark, root = self._spark, self._root
        if name == "trips":
            return star.trips(spark, root)
        if name == "route_metrics":
            return A.route_metrics(self["trips"], star.raw_rides(spark, root), route_dim(spark, root), keep=materialise)
        if name == "overcrowding_events":
            return A.overcrowding_events(star.trips_core(spark, root))
        if name == "persistent_overcrowding":
            return A.persistent_overcrowding(self["overcrowding_events"])
        if name == "underutilization":
            return A.underutilization(star.trips_core(spark, root))
        if name == "bunching_events":
            return A.bunching_events(self["trips"])
        if name == "quality_days":
            return A.quality_days(star.trips_core(spark, root))
        if name == "stop_metrics":
            return stop_metrics(spark, root)
        if name == "daily_demand":
            return daily_demand(spark, root)
        if name == "anomalies":
            return A.anomalies(self["daily_demand"])
        if name == "alerts":
            self.prepare(*DECISION_TABLES)
            return build_alerts(self, now=NOW)
        raise KeyError(name)


def unique() -> str:
    return uuid.uuid4().hex
