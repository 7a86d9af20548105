"""Shared SQL views of the domain frames, pulled into a query's WITH clause by name."""

from __future__ import annotations

import re

BAND = "CASE WHEN {h} < 5 THEN 'night' WHEN {h} < 10 THEN 'morning peak' WHEN {h} < 16 THEN 'midday' WHEN {h} < 20 THEN 'evening peak' ELSE 'night' END"
SEVERITY = "CASE WHEN {d} <= 5 THEN 'on time' WHEN {d} <= 9 THEN 'moderate' WHEN {d} <= 30 THEN 'severe' ELSE 'critical' END"
SEASON = "CASE WHEN {m} IN (12,1,2) THEN 'winter' WHEN {m} IN (3,4,5) THEN 'spring' WHEN {m} IN (6,7,8) THEN 'summer' ELSE 'autumn' END"
WEEKDAY = "(isodow({d}) - 1)"


def clip100(x: str) -> str:
    return f"greatest(least({x}, 100e0), 0e0)"


VIEWS: dict[str, str] = {}

VIEWS["trips_core"] = f"""
SELECT *, {SEASON.format(m='month')} AS season, {BAND.format(h='hour')} AS time_band,
  {SEVERITY.format(d='departure_delay_min')} AS delay_severity, departure_delay_min <= 5 AS on_time,
  CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END AS day_type,
  (hour >= 5 AND hour < 10) OR (hour >= 16 AND hour < 20) AS is_peak
FROM (
  SELECT event_id AS trip_id, user_id % 20 AS route_id, user_id AS vehicle_id, ts AS scheduled_departure,
    CAST(ts AS DATE) AS date, event_id % 2 AS direction, value/5 - 5 AS departure_delay_min,
    CASE event_type WHEN 'signup' THEN 'rain' WHEN 'purchase' THEN 'snow' WHEN 'error' THEN 'storm' ELSE 'clear' END AS weather,
    k AS boardings, k AS alightings, k*1.2e0 AS occupancy_max_pct, k*0.7e0 AS occupancy_avg_pct,
    k/4e0 + 20e0 AS scheduled_travel_min, k/4e0 + 20e0 + value/5 - 5 AS actual_travel_min, k/10e0 + 2e0 AS distance_km,
    epoch_us(ts) AS us, {WEEKDAY.format(d='ts')} AS weekday, month(ts) AS month, isodow(ts) >= 6 AS is_weekend, hour(ts) AS hour
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
VIEWS["trips"] = """
SELECT *, (us - lag(us) OVER w)/6e7 AS scheduled_headway_min,
  (us - lag(us) OVER w)/6e7 + departure_delay_min - lag(departure_delay_min) OVER w AS actual_headway_min
FROM trips_core WINDOW w AS (PARTITION BY route_id, date ORDER BY us, trip_id)"""
VIEWS["routes"] = """
SELECT s_suppkey AS route_id, s_name AS route_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'feeder' ELSE 'express' END AS category,
  s_suppkey % 20 + 5.5e0 AS length_km, s_suppkey % 40 + 5 AS stops_count FROM supplier"""
VIEWS["vehicles"] = """
SELECT c_custkey AS vehicle_id, CASE c_custkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'articulated' ELSE 'mini' END AS vehicle_type,
  CASE c_custkey % 3 WHEN 0 THEN 80 WHEN 1 THEN 130 ELSE 45 END AS capacity, c_acctbal FROM customer"""
VIEWS["raw_vehicles"] = """
SELECT vehicle_id, vehicle_type, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 100 THEN 0 ELSE capacity END AS capacity FROM vehicles"""
VIEWS["stops"] = """
SELECT p_partkey AS stop_id, p_name AS stop_name, r_name AS zone, (p_partkey % 100)/100e0 + 40e0 AS lat,
  (p_partkey % 77)/100e0 + 20e0 AS lon FROM part LEFT JOIN region ON p_partkey % 5 = r_regionkey"""
VIEWS["order_trips"] = """
SELECT o_orderkey AS trip_id, o_custkey % 20 AS route_id, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS trip_status,
  o_custkey AS vehicle_id FROM orders"""
VIEWS["raw_stop_visits"] = """
SELECT l_orderkey AS trip_id, l_linenumber AS seq, l_partkey AS stop_id, l_linenumber*3 AS hour, l_quantity AS boarded,
  l_quantity*(1 - 5*l_discount) AS alighted, l_extendedprice/5000 - 5 AS arr_delay_min, 25e0 + 2.5e0*l_quantity AS dwell_sec,
  l_quantity/45 AS occupancy_after, l_quantity AS onboard_after, l_suppkey AS visit_ref, l_tax AS tax,
  CAST(l_shipdate AS DATE) AS ship_date FROM lineitem"""
VIEWS["stop_facts"] = f"""
SELECT v.*, {BAND.format(h='v.hour')} AS time_band, t.route_id, t.date, s.stop_name, s.zone
FROM raw_stop_visits v LEFT JOIN order_trips t ON v.trip_id = t.trip_id LEFT JOIN stops s ON v.stop_id = s.stop_id"""
VIEWS["raw_rides"] = f"""
SELECT *, {BAND.format(h='hour')} AS time_band FROM (
  SELECT l_orderkey AS trip_id, l_suppkey % 20 AS route_id, o_custkey AS passenger_id, l_suppkey AS alighting_ref,
    CAST(o_orderdate AS DATE) AS date, l_linenumber*3 AS hour, l_extendedprice*(1 - l_discount) AS fare,
    l_quantity AS distance_km, l_extendedprice/1000 AS travel_min,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'single' WHEN '2-HIGH' THEN 'day' WHEN '3-MEDIUM' THEN 'weekly' ELSE 'monthly' END AS pass_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
VIEWS["rides"] = """
SELECT r.*, b.zone AS boarding_zone, a.zone AS alighting_zone FROM raw_rides r
LEFT JOIN (SELECT c_custkey AS k, r_name AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) b ON r.passenger_id = b.k
LEFT JOIN (SELECT s_suppkey AS k, r_name AS zone FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) a ON r.alighting_ref = a.k"""
_EVENT_ROWS = """
SELECT 'EVT-' || strftime(date, '%Y%m%d') || '-' || CAST(ordinal AS VARCHAR) AS event_id, date, ordinal, r_name AS zone,
  CASE r_regionkey WHEN 0 THEN 'sports' WHEN 1 THEN 'concert' WHEN 2 THEN 'festival' WHEN 3 THEN 'accident' ELSE 'construction' END AS kind,
  r_regionkey/10e0 + 1e0 AS demand_multiplier, r_regionkey*2e0 + 1e0 AS extra_delay_min
FROM ({days}) d, (VALUES (0), (1)) o(ordinal), region WHERE r_regionkey = (step + ordinal) % 5"""
VIEWS["ride_events"] = _EVENT_ROWS.format(
    days="SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, dayofyear(o_orderdate)//30 AS step FROM orders WHERE dayofyear(o_orderdate) % 30 = 0"
)
VIEWS["trip_events"] = _EVENT_ROWS.format(
    days="SELECT DISTINCT CAST(ts AS DATE) AS date, day(ts)//5 AS step FROM events WHERE day(ts) % 5 = 0"
)
VIEWS["trip_calendar"] = """
SELECT date, day(date) % 10 = 0 AS is_holiday, CAST(day(date) % 40 - 5 AS DOUBLE) AS temp_c, CAST(day(date) % 17 AS DOUBLE) AS precip_mm
FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)"""
VIEWS["route_stops"] = """
SELECT t.route_id, v.seq, min(v.stop_id) AS stop_id FROM raw_stop_visits v JOIN order_trips t ON v.trip_id = t.trip_id GROUP BY 1, 2"""
VIEWS["route_zones"] = "SELECT DISTINCT rs.route_id, s.zone FROM route_stops rs JOIN stops s ON rs.stop_id = s.stop_id"
VIEWS["passengers"] = """
SELECT c_custkey AS passenger_id, c_mktsegment AS age_group, CASE WHEN c_acctbal >= 0 THEN CAST(c_custkey % 73 + 1940 AS DOUBLE) END AS birth_year,
  CAST(CAST(floor(c_acctbal/20) AS BIGINT) AS VARCHAR) AS annual_trips FROM customer"""
VIEWS["trip_facts"] = """
SELECT t.*, r.category AS route_category, r.length_km AS route_length_km, v.vehicle_type, v.capacity
FROM trips t LEFT JOIN routes r ON t.route_id = r.route_id LEFT JOIN vehicles v ON t.vehicle_id = v.vehicle_id"""

VALID = "(scheduled_headway_min > 2 AND actual_headway_min IS NOT NULL)"
BUNCHED = f"({VALID} AND actual_headway_min < 0.5e0*scheduled_headway_min)"
GAPPED = f"({VALID} AND actual_headway_min > 1.75e0*scheduled_headway_min)"
VIEWS["route_base"] = f"""
SELECT route_id, count(*) AS trips, avg(departure_delay_min) AS avg_delay_min, avg(CAST(on_time AS INT)) AS on_time_share,
  avg(occupancy_avg_pct) AS occupancy_avg_pct, avg(occupancy_max_pct) AS occupancy_max_pct,
  avg(CAST(occupancy_max_pct >= 85 AS INT)) AS crowding_share, avg(CAST(occupancy_max_pct >= 100 AS INT)) AS critical_crowding_share,
  avg(CAST(occupancy_avg_pct <= 25 AS INT)) AS underutilized_share, avg(scheduled_travel_min) AS avg_scheduled_travel_min,
  avg(actual_travel_min) AS avg_actual_travel_min, avg(scheduled_headway_min) AS avg_headway_min,
  coalesce(stddev_samp(scheduled_headway_min), 0) AS headway_std_min,
  stddev_samp(scheduled_headway_min)/nullif(avg(scheduled_headway_min), 0) AS headway_cv,
  avg(CAST(delay_severity IN ('severe', 'critical') AS INT)) AS severe_critical_share,
  avg(CAST(departure_delay_min BETWEEN -2 AND 2 AS INT)) AS adherence_share,
  count(*) FILTER (WHERE {BUNCHED})/greatest(count(*) FILTER (WHERE {VALID}), 1) AS bunching_share,
  count(*) FILTER (WHERE {GAPPED})/greatest(count(*) FILTER (WHERE {VALID}), 1) AS gapping_share,
  quantile_cont(departure_delay_min, 0.9) AS p90_delay_min
FROM trips GROUP BY route_id"""
VIEWS["route_volume"] = """
SELECT b.*, coalesce(v.passengers, 0) AS passengers, coalesce(v.revenue, 0) AS revenue, coalesce(v.passengers, 0)/b.trips AS avg_boardings_per_trip
FROM route_base b LEFT JOIN (SELECT route_id, count(*) AS passengers, sum(fare) AS revenue FROM rides GROUP BY 1) v ON b.route_id = v.route_id"""
VIEWS["route_scored"] = f"""
SELECT *, CASE WHEN route_score >= 80 THEN 'Top Performer' WHEN route_score >= 65 THEN 'Solid' WHEN route_score >= 50 THEN 'Needs Attention' ELSE 'Action Required' END AS route_class
FROM (SELECT *, 0.20e0*demand_score + 0.25e0*reliability_score + 0.15e0*occupancy_score + 0.15e0*delay_score + 0.10e0*adherence_score + 0.15e0*bunching_score AS route_score
FROM (SELECT *, {clip100('100e0 - abs(occupancy_avg_pct - 55e0)*(100e0/55e0)')} AS occupancy_score, on_time_share*100 AS reliability_score,
  adherence_share*100 AS adherence_score, {clip100('100e0 - avg_delay_min*(100e0/30e0)')} AS delay_score,
  {clip100('100e0 - bunching_share*100')} AS bunching_score,
  {clip100('passengers*100/nullif(max(passengers) OVER (), 0)')} AS demand_score FROM route_volume))"""
VIEWS["route_metrics"] = """
SELECT s.*, c.category, c.length_km, c.route_name, row_number() OVER (ORDER BY route_score DESC, s.route_id) AS route_rank
FROM route_scored s LEFT JOIN (SELECT route_id, category, length_km, route_name FROM routes) c ON s.route_id = c.route_id"""
VIEWS["stop_base"] = """
SELECT stop_id, count(*) AS visits, sum(boarded) AS boardings, sum(alighted) AS alightings, avg(arr_delay_min) AS avg_arr_delay_min,
  avg(CAST(arr_delay_min <= 5 AS INT)) AS on_time_share, avg(CAST(occupancy_after >= 0.85e0 AS INT)) AS crowding_share,
  avg(dwell_sec) AS avg_dwell_sec, avg(onboard_after) AS peak_onboard_avg, quantile_cont(arr_delay_min, 0.95) AS p95_arr_delay_min
FROM stop_facts GROUP BY stop_id"""
VIEWS["stop_peak"] = """
SELECT stop_id, hour AS peak_hour, s AS max_hourly_boardings FROM (
  SELECT stop_id, hour, sum(boarded) AS s FROM stop_facts GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY s DESC, hour) = 1"""
VIEWS["stop_scored"] = f"""
SELECT *, {clip100('100e0*(0.4e0*least(p95_arr_delay_min/20e0, 1e0) + 0.3e0*crowding_share + 0.3e0*boardings/greatest(max(boardings) OVER (), 1))')} AS bottleneck_score
FROM stop_base"""
VIEWS["stop_metrics"] = """
SELECT b.*, p.peak_hour, p.max_hourly_boardings, s.stop_name, s.zone,
  b.bottleneck_score >= (SELECT quantile_cont(bottleneck_score, 0.6) FROM stop_scored) AS is_bottleneck,
  b.visits <= (SELECT quantile_cont(CAST(visits AS DOUBLE), 0.05) FROM stop_base) AS is_terminal
FROM stop_scored b LEFT JOIN stop_peak p ON b.stop_id = p.stop_id LEFT JOIN stops s ON b.stop_id = s.stop_id"""
VIEWS["daily_demand"] = """
SELECT route_id, date, count(*) AS passengers, sum(fare) AS revenue, avg(travel_min) AS avg_travel_min,
  isodow(date) >= 6 AS is_weekend, month(date) AS month FROM rides GROUP BY route_id, date"""
VIEWS["band_shares"] = """
SELECT *, passengers/greatest(sum(passengers) OVER (PARTITION BY route_id), 1) AS band_share
FROM (SELECT route_id, time_band, count(*) AS passengers FROM rides GROUP BY 1, 2)"""
VIEWS["peak_patterns"] = """
SELECT b.*, p.primary_peak, p.secondary_peak FROM band_shares b JOIN (
  SELECT route_id, max(CASE WHEN rn = 1 THEN time_band END) AS primary_peak, coalesce(max(CASE WHEN rn = 2 THEN time_band END), '') AS secondary_peak
  FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY band_share DESC, time_band) AS rn FROM band_shares) GROUP BY 1) p ON b.route_id = p.route_id"""
VIEWS["anomalies"] = """
SELECT *, CASE WHEN z_score > 0 THEN 'high demand' ELSE 'low demand' END AS anomaly_type FROM (
  SELECT *, (passengers - avg(passengers) OVER w)/nullif(stddev_samp(passengers) OVER w, 0) AS z_score
  FROM daily_demand WINDOW w AS (PARTITION BY route_id)) WHERE abs(z_score) > 2.5"""
VIEWS["overcrowding_events"] = """
SELECT *, CASE WHEN crowded_share >= 0.4e0 OR critical_trips > 0 THEN 'critical' ELSE 'high' END AS severity FROM (
  SELECT *, crowded_trips/trips_total AS crowded_share, critical_trips/trips_total AS critical_share FROM (
    SELECT route_id, date, time_band, count(*) AS trips_total, count(*) FILTER (WHERE occupancy_max_pct >= 85) AS crowded_trips,
      count(*) FILTER (WHERE occupancy_max_pct >= 100) AS critical_trips, avg(occupancy_max_pct) AS avg_occupancy_max_pct
    FROM trips_core GROUP BY 1, 2, 3)) WHERE crowded_share >= 0.2e0"""
VIEWS["persistent_overcrowding"] = """
SELECT route_id, CAST(sum(trips_total) AS BIGINT) AS all_crowded_trips, count(DISTINCT date) AS crowded_days,
  (SELECT string_agg(b, ', ' ORDER BY b) FROM (SELECT DISTINCT o2.time_band AS b FROM overcrowding_events o2 WHERE o2.route_id = o.route_id)) AS peak_crowding_bands,
  count(DISTINCT CASE WHEN severity = 'critical' THEN date END) AS critical_days
FROM overcrowding_events o GROUP BY route_id HAVING count(DISTINCT date) >= 15"""
VIEWS["underutilization"] = """
SELECT * FROM (SELECT *, underused_trips/trips_total AS underused_share FROM (
  SELECT route_id, time_band, count(*) AS trips_total, count(*) FILTER (WHERE occupancy_max_pct <= 25) AS underused_trips,
    avg(occupancy_max_pct) AS avg_occupancy_pct, avg(boardings) AS avg_boardings FROM trips_core GROUP BY 1, 2)) WHERE underused_share >= 0.5e0"""
VIEWS["bunching_events"] = f"""
SELECT route_id, date, time_band, count(*) AS bunched_trips, avg(actual_headway_min/scheduled_headway_min) AS avg_headway_ratio
FROM trips WHERE {BUNCHED} GROUP BY 1, 2, 3"""
VIEWS["quality_days"] = f"""
SELECT *, 0.7e0*on_time_share*100 + 0.3e0*delay_score AS quality_score,
  CASE WHEN on_time_share <= 0.55e0 THEN 'critical' WHEN on_time_share <= 0.75e0 THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT *, on_time_trips/trips_total AS on_time_share, {clip100('100e0 - avg_delay_min*(100e0/30e0)')} AS delay_score FROM (
  SELECT route_id, date, count(*) AS trips_total, count(*) FILTER (WHERE on_time) AS on_time_trips, avg(departure_delay_min) AS avg_delay_min,
    count(*) FILTER (WHERE delay_severity IN ('severe', 'critical')) AS severe_trips FROM trips_core GROUP BY 1, 2))"""
_RELIABLE = "avg(CASE WHEN scheduled_headway_min > 0 AND actual_headway_min IS NOT NULL THEN CAST(actual_headway_min BETWEEN 0.8e0*scheduled_headway_min AND 1.2e0*scheduled_headway_min AS INT) END)"
VIEWS["frequency_analysis"] = f"""
SELECT *, scheduled_trips/nullif(avg_scheduled_headway_min, 0)*60 AS trips_per_hour, headway_std_min/nullif(avg_scheduled_headway_min, 0) AS headway_cv,
  avg_actual_headway_min - avg_scheduled_headway_min AS service_gap_min, {WEEKDAY.format(d='date')} AS weekday, month(date) AS month, isodow(date) >= 6 AS is_weekend
FROM (SELECT route_id, date, time_band AS time_period, count(*) AS scheduled_trips, avg(scheduled_headway_min) AS avg_scheduled_headway_min,
  avg(actual_headway_min) AS avg_actual_headway_min, stddev_samp(scheduled_headway_min) AS headway_std_min, {_RELIABLE} AS headway_reliability
  FROM trips GROUP BY 1, 2, 3)"""
VIEWS["headway_analysis"] = f"""
SELECT *, scheduled_std/nullif(scheduled_mean, 0) AS headway_cv FROM (
  SELECT route_id, time_band AS time_period, avg(scheduled_headway_min) AS scheduled_mean, stddev_samp(scheduled_headway_min) AS scheduled_std,
    avg(actual_headway_min) AS actual_mean, stddev_samp(actual_headway_min) AS actual_std, min(actual_headway_min) AS min_headway,
    max(actual_headway_min) AS max_headway, count(*) AS trips, {_RELIABLE} AS headway_reliability, avg(CAST(on_time AS INT)) AS on_time_rate
  FROM trips GROUP BY 1, 2)"""
VIEWS["service_level"] = """
SELECT *, (0.4e0*coalesce(on_time_rate, 0) + 0.3e0*coalesce(headway_reliability, 0) + 0.3e0*coalesce(service_regularity, 50)/100)*100 AS service_reliability
FROM (SELECT f.* EXCLUDE (headway_reliability), h.headway_reliability, h.on_time_rate, h.headway_cv AS period_headway_cv,
  CASE WHEN h.headway_cv IS NOT NULL THEN (1 - greatest(least(h.headway_cv, 1), 0))*100 END AS service_regularity
  FROM frequency_analysis f LEFT JOIN headway_analysis h ON f.route_id = h.route_id AND f.time_period = h.time_period)"""
VIEWS["segments"] = """
SELECT *, CASE WHEN trips >= 90 AND peak_share >= 0.7e0 THEN 'commuter' WHEN trips >= 90 THEN 'frequent' WHEN trips >= 20 THEN 'regular'
  WHEN trips >= 4 THEN 'occasional' ELSE 'rare' END AS segment FROM (
  SELECT r.passenger_id, count(*) AS trips, avg(CAST(time_band IN ('morning peak', 'evening peak') AS INT)) AS peak_share, avg(distance_km) AS avg_distance_km,
    avg(travel_min) AS avg_travel_min, sum(fare) AS total_spend, count(DISTINCT date) AS active_days, any_value(m.pass_type) AS primary_pass_type
  FROM raw_rides r JOIN (SELECT passenger_id, pass_type FROM (SELECT passenger_id, pass_type, count(*) AS n FROM raw_rides GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY passenger_id ORDER BY n DESC, pass_type) = 1) m ON r.passenger_id = m.passenger_id GROUP BY 1)"""
VIEWS["reliability_profile"] = f"""
SELECT *, 0.7e0*on_time_rate + 0.3e0*delay_score AS quality_score FROM (
SELECT *, CASE WHEN on_time_rate/100 <= 0.55e0 THEN 'critical' WHEN on_time_rate/100 <= 0.75e0 THEN 'degraded' ELSE 'healthy' END AS reliability_flag,
  {clip100('100e0 - avg_delay_min*(100e0/30e0)')} AS delay_score FROM (
SELECT route_id, count(*) AS trips, count(DISTINCT date) AS active_days, coalesce(avg(departure_delay_min), 0) AS avg_delay_min,
  coalesce(quantile_cont(departure_delay_min, 0.9), 0) AS p90_delay_min, avg(CAST(on_time AS INT))*100 AS on_time_rate,
  avg(CAST(delay_severity IN ('severe', 'critical') AS INT))*100 AS severe_rate, coalesce(stddev_pop(scheduled_headway_min), 0) AS headway_std,
  100*count(*) FILTER (WHERE scheduled_headway_min > 2 AND actual_headway_min < 0.5e0*scheduled_headway_min)/nullif(count(*) FILTER (WHERE scheduled_headway_min > 2), 0) AS bunching_rate,
  avg(occupancy_max_pct) AS avg_occupancy_max_pct FROM trips GROUP BY route_id))"""


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """The query with every view it reads, directly or not, as common table expressions in dependency order."""
    names = _needed(sql, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
