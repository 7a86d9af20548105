"""Aggregate analytics (A)."""

from __future__ import annotations

from headwise.operators import aggregates as A
from headwise.plans import frames
from headwise.plans.catalog import query
from headwise.plans.oracle import GAPPED, BUNCHED, VALID
from headwise.session import materialise
from headwise.sources import star

DATED = "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM {view}"


@query("A01_route_base_metrics", "SELECT * EXCLUDE (bunching_share, gapping_share, severe_critical_share, adherence_share) FROM route_base")
def _(spark, root):
    return A.route_base(star.trips(spark, root), keep=materialise).drop(
        "bunching_share", "gapping_share", "severe_critical_share", "adherence_share"
    )


@query(
    "A02_bunching_gapping_share",
    f"""SELECT route_id, count(*) FILTER (WHERE {VALID}) AS valid_headway, count(*) FILTER (WHERE {BUNCHED}) AS bunched_trips,
    count(*) FILTER (WHERE {GAPPED}) AS gapped_trips, count(*) FILTER (WHERE {BUNCHED})/greatest(count(*) FILTER (WHERE {VALID}), 1) AS bunching_share,
    count(*) FILTER (WHERE {GAPPED})/greatest(count(*) FILTER (WHERE {VALID}), 1) AS gapping_share FROM trips GROUP BY route_id""",
)
def _(spark, root):
    return A.bunching_shares(star.trips(spark, root))


@query("A03_severe_and_adherence_share", "SELECT route_id, severe_critical_share, adherence_share FROM route_base")
def _(spark, root):
    return A.route_base(star.trips(spark, root), keep=materialise).select("route_id", "severe_critical_share", "adherence_share")


@query("A04_route_volume_revenue", "SELECT route_id, trips, passengers, revenue, avg_boardings_per_trip FROM route_volume")
def _(spark, root):
    base = A.with_volume(A.route_base(star.trips(spark, root), keep=materialise), star.raw_rides(spark, root))
    return base.select("route_id", "trips", "passengers", "revenue", "avg_boardings_per_trip")


@query(
    "A05_route_component_scores",
    "SELECT route_id, demand_score, reliability_score, occupancy_score, delay_score, adherence_score, bunching_score, route_score, route_class FROM route_scored",
)
def _(spark, root):
    base = A.with_volume(A.route_base(star.trips(spark, root), keep=materialise), star.raw_rides(spark, root))
    scored = A.score_parts(materialise(base, "route_volume"))
    return scored.select(
        "route_id", "demand_score", "reliability_score", "occupancy_score", "delay_score", "adherence_score",
        "bunching_score", "route_score", "route_class",
    )


@query("A06_route_metrics_ranked", "SELECT * FROM route_metrics")
def _(spark, root):
    return frames.route_metrics(spark, root)


@query(
    "A07_route_reference",
    """SELECT t.route_id, arg_min(t.route_category, t.trip_id) AS category, arg_min(t.route_length_km, t.trip_id) AS length_km, any_value(r.route_name) AS route_name
    FROM trip_facts t LEFT JOIN routes r ON t.route_id = r.route_id GROUP BY t.route_id""",
)
def _(spark, root):
    return A.route_reference(frames.trip_facts(spark, root), star.routes(spark, root))


@query("A08_stop_metrics", "SELECT * FROM stop_base")
def _(spark, root):
    return A.stop_base(star.raw_stop_visits(spark, root))


@query("A09_stop_peak_hour", "SELECT * FROM stop_peak")
def _(spark, root):
    return A.peak_hour(star.raw_stop_visits(spark, root))


@query("A10_stop_bottlenecks", "SELECT * FROM stop_metrics")
def _(spark, root):
    return frames.stop_metrics(spark, root)


@query(
    "A11_stop_time_bands",
    """SELECT b.*, stop_name, zone FROM (SELECT stop_id, time_band, count(*) AS visits, sum(boarded) AS boardings, sum(alighted) AS alightings, avg(arr_delay_min) AS avg_arr_delay_min,
    avg(CAST(occupancy_after >= 0.85e0 AS INT)) AS crowding_share FROM stop_facts GROUP BY 1, 2) b LEFT JOIN stops s ON b.stop_id = s.stop_id""",
)
def _(spark, root):
    from headwise.functions import scalars as X

    visits = star.raw_stop_visits(spark, root).withColumn("time_band", X.time_band("hour"))
    return A.stop_time_bands(visits, stops=star.stops(spark, root))


@query("A12_daily_demand", DATED.format(view="daily_demand"))
def _(spark, root):
    return frames.daily_demand(spark, root)


@query("A13_band_share_in_route", "SELECT * FROM band_shares")
def _(spark, root):
    return A.band_shares(star.raw_rides(spark, root))


@query("A14_primary_secondary_peak", "SELECT * FROM peak_patterns")
def _(spark, root):
    return A.peak_patterns(star.raw_rides(spark, root))


@query(
    "A15_peak_hours_city",
    """SELECT 'peak_hours_city_wide' AS key, '[' || string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hour) || ']' AS value
    FROM (SELECT hour, count(*) AS n FROM raw_rides GROUP BY 1 ORDER BY n DESC, hour LIMIT 3)""",
)
def _(spark, root):
    return A.peak_hours_city(star.raw_rides(spark, root))


@query("A16_demand_anomalies", DATED.format(view="anomalies"))
def _(spark, root):
    return A.anomalies(frames.daily_demand(spark, root))


_SERIES = """
WITH span AS (SELECT min(date) AS a, max(date) AS b FROM raw_rides),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
delays AS (SELECT date, avg(arr_delay_min) AS delay FROM stop_facts GROUP BY 1),
overall AS (SELECT avg(arr_delay_min) AS delay FROM stop_facts),
series AS (SELECT d.date, CAST(coalesce(r.n, 0) AS DOUBLE) AS demand, coalesce(l.delay, (SELECT delay FROM overall)) AS delay FROM days d
  LEFT JOIN (SELECT date, count(*) AS n FROM raw_rides GROUP BY 1) r ON d.date = r.date LEFT JOIN delays l ON d.date = l.date)
"""


@query("A17_calendar_complete_series", _SERIES + "SELECT CAST(date AS VARCHAR) AS date, demand FROM series")
def _(spark, root):
    from pyspark.sql import functions as F

    from headwise.functions import scalars as X

    demand = star.raw_rides(spark, root).groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("demand"))
    return A.complete_days(demand, "date", {"demand": X.dbl(0.0)})


@query(
    "A18_event_impact",
    _SERIES
    + """, base AS (SELECT e.event_id, e.date, e.zone, e.demand_multiplier, (SELECT avg(demand) FROM series s WHERE s.date BETWEEN e.date - 7 AND e.date - 1) AS bd,
    (SELECT avg(delay) FROM series s WHERE s.date BETWEEN e.date - 7 AND e.date - 1) AS bl FROM ride_events e)
SELECT event_id, CAST(b.date AS VARCHAR) AS date, zone, demand_multiplier AS expected_multiplier, s.demand AS actual_demand, bd AS baseline_demand,
  CASE WHEN bd > 0 THEN (s.demand/bd - 1)*100 ELSE 0e0 END AS demand_delta_pct, s.delay AS actual_avg_delay, bl AS baseline_avg_delay,
  coalesce((s.delay/nullif(bl, 0) - 1)*100, 0) AS delay_delta_pct FROM base b JOIN series s ON b.date = s.date WHERE bd IS NOT NULL""",
)
def _(spark, root):
    visits = star.raw_stop_visits(spark, root).join(star.order_trips(spark, root).select("trip_id", "date"), "trip_id", "left")
    return A.event_impact(star.raw_rides(spark, root), visits, star.ride_events(spark, root), "arr_delay_min")


@query(
    "A19_zone_flow",
    "SELECT boarding_zone, alighting_zone, count(*) AS passengers, avg(fare) AS avg_fare, sum(fare) AS revenue FROM rides GROUP BY 1, 2",
)
def _(spark, root):
    return A.zone_flow(star.rides(spark, root))


@query("A20_od_route_zone", "SELECT route_id, boarding_zone, alighting_zone, count(*) AS passengers FROM rides GROUP BY 1, 2, 3")
def _(spark, root):
    return A.od_matrix(star.rides(spark, root), ["route_id", "boarding_zone", "alighting_zone"])


@query("A20_od_stop_pairs", "SELECT passenger_id, alighting_ref, count(*) AS passengers FROM raw_rides GROUP BY 1, 2")
def _(spark, root):
    return A.od_matrix(star.raw_rides(spark, root), ["passenger_id", "alighting_ref"])


@query(
    "A20_od_route_band_zone",
    "SELECT route_id, time_band, boarding_zone, alighting_zone, count(*) AS passengers FROM rides GROUP BY 1, 2, 3, 4",
)
def _(spark, root):
    return A.od_matrix(star.rides(spark, root), ["route_id", "time_band", "boarding_zone", "alighting_zone"])


@query(
    "A21_top_od_pairs",
    "SELECT passenger_id, alighting_ref, count(*) AS passengers FROM raw_rides GROUP BY 1, 2 ORDER BY passengers DESC, 1, 2 LIMIT 30",
)
def _(spark, root):
    keys = ["passenger_id", "alighting_ref"]
    return A.top_pairs(A.od_matrix(star.raw_rides(spark, root), keys), keys)


@query("A22_overcrowding_events", DATED.format(view="overcrowding_events"))
def _(spark, root):
    return A.overcrowding_events(star.trips_core(spark, root))


@query("A23_persistent_overcrowding", "SELECT * FROM persistent_overcrowding")
def _(spark, root):
    return A.persistent_overcrowding(A.overcrowding_events(star.trips_core(spark, root)))


@query("A24_underutilization", "SELECT * FROM underutilization")
def _(spark, root):
    return A.underutilization(star.trips_core(spark, root))


@query("A25_bunching_events", DATED.format(view="bunching_events"))
def _(spark, root):
    return A.bunching_events(star.trips(spark, root))


@query("A26_quality_days", DATED.format(view="quality_days"))
def _(spark, root):
    return A.quality_days(star.trips_core(spark, root))


@query("A27_passenger_segmentation", "SELECT * FROM segments")
def _(spark, root):
    return A.segmentation(star.raw_rides(spark, root))


@query(
    "A28_segment_summary",
    """SELECT *, passengers/sum(passengers) OVER () AS share_of_passengers,
    CASE segment WHEN 'commuter' THEN 0 WHEN 'frequent' THEN 1 WHEN 'regular' THEN 2 WHEN 'occasional' THEN 3 ELSE 4 END AS segment_order FROM (
    SELECT segment, count(*) AS passengers, avg(trips) AS avg_trips, avg(peak_share) AS avg_peak_share, avg(avg_distance_km) AS avg_distance_km,
    avg(total_spend) AS avg_spend FROM segments GROUP BY 1)""",
)
def _(spark, root):
    return A.segment_summary(A.segmentation(star.raw_rides(spark, root)))


@query(
    "A29_headway_reliability",
    """SELECT route_id, time_band, avg(CAST(actual_headway_min BETWEEN 0.8e0*scheduled_headway_min AND 1.2e0*scheduled_headway_min AS INT)) AS headway_reliability
    FROM trips WHERE scheduled_headway_min > 0 AND actual_headway_min IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, root):
    return A.headway_reliability(star.trips(spark, root), ["route_id", "time_band"])


@query("A30_service_frequency", DATED.format(view="frequency_analysis"))
def _(spark, root):
    return A.frequency_analysis(star.trips(spark, root))


@query("A31_headway_distribution", "SELECT * FROM headway_analysis")
def _(spark, root):
    return A.headway_analysis(star.trips(spark, root))


@query("A32_service_level", DATED.format(view="service_level"))
def _(spark, root):
    return A.service_level(star.trips(spark, root))


@query(
    "A33_peak_frequency_ratio",
    """SELECT route_id, peak_freq, offpeak_freq, peak_freq/nullif(offpeak_freq, 0) AS peak_ratio FROM (
    SELECT route_id, count(*) FILTER (WHERE hour IN (7,8,9,16,17,18)) AS peak_freq, count(*) FILTER (WHERE hour NOT IN (7,8,9,16,17,18)) AS offpeak_freq
    FROM trips_core GROUP BY 1)""",
)
def _(spark, root):
    return A.peak_frequency(star.trips_core(spark, root))


@query(
    "A33_hour_pivot",
    "SELECT route_id, " + ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS h{h:02d}" for h in range(24)) + " FROM trips_core GROUP BY 1",
)
def _(spark, root):
    return A.hour_pivot(star.trips_core(spark, root))


@query(
    "A34_busiest_and_quietest_hours",
    """SELECT route_id, string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hi) FILTER (WHERE hi <= 3) AS peak_hours,
    string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY lo) FILTER (WHERE lo <= 3) AS offpeak_hours FROM (
    SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, hour) AS hi, row_number() OVER (PARTITION BY route_id ORDER BY n, hour) AS lo
    FROM (SELECT route_id, hour, count(*) AS n FROM trips_core GROUP BY 1, 2)) GROUP BY 1""",
)
def _(spark, root):
    return A.extreme_hours(star.trips_core(spark, root))


@query("A35_route_reliability_profile", "SELECT * FROM reliability_profile")
def _(spark, root):
    return A.reliability_profile(star.trips(spark, root), keep=materialise)


@query(
    "A36_band_punctuality_and_load",
    """SELECT route_id, time_band, count(*) AS observations, coalesce(avg(arr_delay_min), 0) AS avg_arr_delay_min, avg(CAST(arr_delay_min > 5 AS INT))*100 AS late_share,
    avg(onboard_after) AS avg_onboard, avg(occupancy_after) AS avg_occupancy FROM stop_facts GROUP BY 1, 2""",
)
def _(spark, root):
    return A.band_punctuality(star.stop_facts(spark, root))


@query(
    "A37_fleet_profile",
    """SELECT l.*, p.trips_per_vehicle_day FROM (SELECT vehicle_type, count(*) AS trips, avg(occupancy_max_pct) AS mean_load,
    quantile_cont(occupancy_max_pct, 0.9) AS p90_load, quantile_cont(occupancy_max_pct, 0.99) AS p99_load FROM trip_facts GROUP BY 1) l
    JOIN (SELECT vehicle_type, avg(n) AS trips_per_vehicle_day FROM (SELECT vehicle_type, vehicle_id, date, count(*) AS n FROM trip_facts GROUP BY 1, 2, 3) GROUP BY 1) p
    ON l.vehicle_type = p.vehicle_type""",
)
def _(spark, root):
    return A.fleet_profile(frames.trip_facts(spark, root))
