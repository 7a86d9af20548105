"""Joins and integration (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwise.operators import aggregates as A
from headwise.operators import features as Fe
from headwise.operators import joins as J
from headwise.plans import frames
from headwise.plans.catalog import query
from headwise.sources import star

TEXT_DATES = "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM {view}"


@query(
    "J01_left_join_new_columns_only",
    """SELECT v.trip_id, v.seq, v.stop_id, v.ship_date::VARCHAR AS ship_date, t.route_id, CAST(t.date AS VARCHAR) AS date, t.trip_status, t.vehicle_id
    FROM raw_stop_visits v LEFT JOIN order_trips t ON v.trip_id = t.trip_id""",
)
def _(spark, root):
    visits = star.raw_stop_visits(spark, root).select("trip_id", "seq", "stop_id", "ship_date")
    return J.add_context(visits, star.order_trips(spark, root), "trip_id")


@query(
    "J02_join_row_guard",
    """SELECT (SELECT count(*) FROM raw_stop_visits) AS source_rows, count(*) AS merged_rows, count(*) - count(DISTINCT (trip_id, seq)) AS duplicated_keys,
    count(*) FILTER (WHERE route_id IS NULL OR date IS NULL OR stop_name IS NULL OR zone IS NULL) AS rows_with_missing_context FROM stop_facts""",
)
def _(spark, root):
    keys = ["trip_id", "seq"]
    return J.join_diagnostics(star.raw_stop_visits(spark, root), star.stop_facts(spark, root, gap_keys=keys), keys, J.GAP)


@query(
    "J03_trip_facts",
    "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM (SELECT * EXCLUDE (scheduled_departure) FROM trip_facts)",
)
def _(spark, root):
    return frames.trip_facts(spark, root).drop("scheduled_departure")


@query("J04_stop_facts", "SELECT * REPLACE (CAST(date AS VARCHAR) AS date, CAST(ship_date AS VARCHAR) AS ship_date) FROM stop_facts")
def _(spark, root):
    return star.stop_facts(spark, root)


@query(
    "J05_passenger_flow",
    """SELECT r.trip_id, r.board_stop, r.alight_stop, r.fare, CAST(t.date AS VARCHAR) AS date, t.route_id, b.zone AS boarding_zone, a.zone AS alighting_zone
    FROM (SELECT l_orderkey AS trip_id, l_partkey AS board_stop, l_suppkey AS alight_stop, l_extendedprice AS fare FROM lineitem) r
    LEFT JOIN order_trips t ON r.trip_id = t.trip_id LEFT JOIN stops b ON r.board_stop = b.stop_id LEFT JOIN stops a ON r.alight_stop = a.stop_id""",
)
def _(spark, root):
    rides = star.table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("board_stop"),
        F.col("l_suppkey").alias("alight_stop"), F.col("l_extendedprice").alias("fare"),
    )
    context = star.order_trips(spark, root).select("trip_id", "route_id", "date")
    return J.passenger_flow(rides, context, star.stops(spark, root), "board_stop", "alight_stop")


@query("J06_route_zones", "SELECT * FROM route_zones")
def _(spark, root):
    return frames.route_zones(spark, root)


@query(
    "J07_event_multiplier_by_zone",
    """SELECT CAST(d.date AS VARCHAR) AS date, d.route_id, d.passengers, coalesce(e.m, 1e0) AS event_multiplier FROM daily_demand d LEFT JOIN (
    SELECT z.route_id, v.date, max(v.demand_multiplier) AS m FROM route_zones z JOIN ride_events v ON z.zone = v.zone GROUP BY 1, 2) e
    ON d.route_id = e.route_id AND d.date = e.date""",
)
def _(spark, root):
    daily = frames.daily_demand(spark, root).select("route_id", "date", "passengers")
    return J.event_multiplier(daily, frames.route_zones(spark, root), star.ride_events(spark, root))


@query(
    "J08_last_event_of_day",
    """SELECT t.trip_id, coalesce(e.m, 1e0) AS event_demand_mult, coalesce(e.x, 0e0) AS event_extra_delay, CAST(coalesce(e.x, 0e0) > 0 AS INT) AS has_event
    FROM trips_core t LEFT JOIN (SELECT z.route_id, v.date, arg_max(v.demand_multiplier, v.ordinal) AS m, arg_max(v.extra_delay_min, v.ordinal) AS x
    FROM route_zones z JOIN trip_events v ON z.zone = v.zone GROUP BY 1, 2) e ON t.route_id = e.route_id AND t.date = e.date""",
)
def _(spark, root):
    trips = star.trips_core(spark, root).select("trip_id", "route_id", "date")
    out = Fe.event_effects(trips, frames.route_zones(spark, root), star.trip_events(spark, root))
    return out.select("trip_id", "event_demand_mult", "event_extra_delay", "has_event")


@query(
    "J09_days_since_holiday",
    """SELECT t.trip_id, c.d AS days_since_holiday FROM trips_core t LEFT JOIN (SELECT c.date, coalesce(CAST(c.date - (
    SELECT max(h.date) FROM trip_calendar h WHERE h.is_holiday AND h.date < c.date) AS DOUBLE), 365e0) AS d FROM trip_calendar c) c ON t.date = c.date""",
)
def _(spark, root):
    cal = Fe.days_since_flag(star.trip_calendar(spark, root), "date", "is_holiday", "days_since_holiday")
    trips = star.trips_core(spark, root).select("trip_id", "date")
    return trips.join(cal.select("date", "days_since_holiday"), "date", "left").drop("date")


@query(
    "J10_zone_in_out_net",
    """SELECT coalesce(o.zone, i.zone) AS zone, coalesce(o.n, 0) AS outflow, coalesce(i.n, 0) AS inflow, coalesce(i.n, 0) - coalesce(o.n, 0) AS net FROM
    (SELECT boarding_zone AS zone, count(*) AS n FROM rides GROUP BY 1) o FULL JOIN (SELECT alighting_zone AS zone, count(*) AS n FROM rides GROUP BY 1) i ON o.zone = i.zone""",
)
def _(spark, root):
    return J.zone_balance(star.rides(spark, root))


@query(
    "J11_semi_join_listed",
    "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM daily_demand WHERE route_id IN (SELECT route_id FROM persistent_overcrowding)",
)
def _(spark, root):
    listed = A.persistent_overcrowding(A.overcrowding_events(star.trips_core(spark, root)))
    return J.only_listed(frames.daily_demand(spark, root), listed.select("route_id"), "route_id")


@query(
    "J12_exclude_covered",
    """SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM overcrowding_events WHERE severity = 'critical'
    AND route_id NOT IN (SELECT route_id FROM underutilization)""",
)
def _(spark, root):
    trips = star.trips_core(spark, root)
    critical = A.overcrowding_events(trips).where("severity = 'critical'")
    return J.not_covered(critical, A.underutilization(trips).select("route_id"), "route_id")


_SERIES = """
WITH cells AS (SELECT route_id, date, time_band, CAST(count(*) AS DOUBLE) AS boardings FROM raw_rides GROUP BY 1, 2, 3),
lagged AS (SELECT *, lag(boardings, 1) OVER w AS a, avg(boardings) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b FROM cells
WINDOW w AS (PARTITION BY route_id, time_band ORDER BY date))
"""


@query(
    "J13_two_model_outputs",
    _SERIES + "SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, a AS pred_a, b AS pred_b, a - b AS difference FROM lagged WHERE a IS NOT NULL",
)
def _(spark, root):
    keys, series = ["route_id", "date", "time_band"], ["route_id", "time_band"]
    cells = Fe.demand_cells(star.raw_rides(spark, root)).select(*keys, F.col("boardings").cast("double").alias("boardings"))
    last = Fe.row_lag(cells, series, "date", "boardings", 1, "pred").where("pred IS NOT NULL")
    mean = Fe.row_rolling_mean(cells, series, "date", "boardings", 7, "pred")
    return J.model_difference(last, mean, keys, "pred")
