"""SQL views of the raw (uncleaned) tables and of their cleaned forms."""

from headwise.plans.oracle import VIEWS

_ID = """CASE {s} WHEN 0 THEN '{p}-' || lpad(CAST({n} AS VARCHAR), {w}, '0') WHEN 1 THEN '{l}' || lpad(CAST({n} AS VARCHAR), {w}, '0')
  WHEN 2 THEN ' {p} ' || lpad(CAST({n} AS VARCHAR), {w}, '0') WHEN 3 THEN '{p}' || lpad(CAST({n} AS VARCHAR), {w}, '0') ELSE '?' END"""
_SPELL = "CASE WHEN l_tax = 0.08e0 THEN 9 ELSE l_linenumber % 4 END"
_STAMP = "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"


def alias(c: str) -> str:
    return f"upper(replace(replace(trim({c}), '-', ''), ' ', ''))"


VIEWS["route_names"] = "SELECT DISTINCT 'R-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS route_id FROM orders"
VIEWS["raw_trips"] = f"""
SELECT l_orderkey*10 + l_linenumber AS trip_id, {_ID.format(s=_SPELL, p='R', l='r', n='(l_suppkey % 20)', w=3)} AS route_id,
  CASE WHEN l_discount = 0.03e0 THEN NULL ELSE l_partkey END AS vehicle_id, CASE WHEN l_discount = 0 THEN 'unknown' ELSE {_STAMP} END AS scheduled_departure,
  CASE WHEN l_tax <> 0 THEN {_STAMP} END AS actual_departure, CASE WHEN l_discount = 0.1e0 THEN 'n/a' ELSE CAST(l_extendedprice/1000 - 5 AS VARCHAR) END AS departure_delay_min,
  CASE WHEN l_tax <> 0.02e0 THEN l_quantity*5 END AS occupancy_max_pct, CASE WHEN l_tax <> 0.05e0 THEN l_quantity*3 END AS occupancy_avg_pct,
  l_quantity*10 - 50 AS boardings, l_quantity*9 - 30 AS alightings, l_quantity AS distance_km, l_quantity + 20 AS scheduled_travel_min, l_quantity + 22 AS actual_travel_min,
  CASE WHEN l_linestatus = 'O' THEN 'wknd' WHEN l_returnflag = 'R' THEN 'holliday' ELSE 'weekday' END AS day_type,
  CASE l_linenumber WHEN 1 THEN 'rainy' WHEN 2 THEN 'clearr' WHEN 3 THEN 'snow' WHEN 4 THEN 'thunderstorm' WHEN 5 THEN 'fog' WHEN 6 THEN 'clear' ELSE 'rain' END AS weather,
  l_suppkey AS seat_ref FROM lineitem"""
VIEWS["vehicle_pools"] = "SELECT 'R-' || lpad(CAST(c_custkey % 20 AS VARCHAR), 3, '0') AS route_id, c_custkey AS vehicle_id FROM customer"
VIEWS["raw_visits"] = f"""
SELECT l_orderkey AS trip_id, l_linenumber AS seq, {_ID.format(s=_SPELL, p='S', l='s', n='l_partkey', w=7)} AS stop_id,
  CASE WHEN l_discount <> 0.04e0 THEN {_STAMP} END AS scheduled_arrival, CASE WHEN l_tax <> 0.01e0 THEN {_STAMP} ELSE 'lost' END AS actual_arrival,
  CASE WHEN l_discount = 0.06e0 THEN 'n/a' ELSE CAST(l_extendedprice/500 - 20 AS VARCHAR) END AS arr_delay_min, l_quantity AS boarded,
  CASE WHEN l_discount = 0.02e0 THEN NULL ELSE l_quantity*(1 - 5*l_discount) END AS alighted, l_partkey AS stop_ref_order, l_suppkey AS visit_ref FROM lineitem"""
VIEWS["stop_names"] = "SELECT 'S-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS stop_id FROM part"
VIEWS["valid_trips"] = "SELECT trip_id, route_id, route_id*4 + 20 AS capacity FROM order_trips WHERE trip_status <> 'P'"
VIEWS["raw_tickets"] = """
SELECT l_orderkey*10 + l_linenumber AS ticket_id, l_orderkey AS trip_id, l_suppkey % 20 AS route_id, CASE WHEN l_tax = 0.03e0 THEN NULL ELSE o_custkey END AS passenger_id,
  CASE WHEN l_tax = 0.01e0 THEN '??' ELSE strftime(o_orderdate + to_hours(l_linenumber*3), '%Y-%m-%d %H:%M:%S') END AS boarding_datetime,
  strftime(o_orderdate + to_hours(l_linenumber*3) + to_minutes(CAST(floor(l_extendedprice/1000 - 10) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS alighting_datetime,
  CASE WHEN l_discount <> 0.05e0 THEN CAST(l_quantity*3 AS VARCHAR) END AS distance_km, CASE WHEN l_discount = 0.07e0 THEN 'free' ELSE CAST(l_extendedprice/50 AS VARCHAR) END AS fare,
  l_extendedprice/200 AS travel_min, CASE o_orderpriority WHEN '1-URGENT' THEN 'single' WHEN '2-HIGH' THEN 'day' WHEN '3-MEDIUM' THEN 'weekly' WHEN '5-LOW' THEN 'monthly' ELSE 'season' END AS pass_type,
  l_partkey AS part_ref, l_suppkey AS alighting_ref, l_extendedprice AS fare_order, l_quantity AS distance_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["trips_named"] = f"""
SELECT r.* REPLACE (a.canonical AS route_id) FROM raw_trips r LEFT JOIN (SELECT {alias('route_id')} AS k, min(route_id) AS canonical FROM route_names GROUP BY 1) a ON {alias('r.route_id')} = a.k"""
VIEWS["trips_first"] = """
SELECT * FROM trips_named QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY seat_ref NULLS FIRST, vehicle_id NULLS FIRST, departure_delay_min NULLS FIRST, boardings NULLS FIRST, distance_km NULLS FIRST) = 1"""
VIEWS["trips_kept"] = """
SELECT * REPLACE (try_cast(scheduled_departure AS TIMESTAMP) AS scheduled_departure, coalesce(try_cast(actual_departure AS TIMESTAMP), try_cast(scheduled_departure AS TIMESTAMP)) AS actual_departure,
  try_cast(departure_delay_min AS DOUBLE) AS departure_delay_min) FROM trips_first WHERE try_cast(scheduled_departure AS TIMESTAMP) IS NOT NULL AND route_id IN (SELECT route_id FROM route_names)"""
VIEWS["trips_vehicled"] = """
SELECT k.*, v.capacity FROM (SELECT t.* REPLACE (CASE WHEN t.vehicle_id IS NULL THEN (SELECT min(vehicle_id) FROM vehicles) WHEN t.vehicle_id NOT IN (SELECT vehicle_id FROM vehicles)
  THEN coalesce(p.first, (SELECT min(vehicle_id) FROM vehicles)) ELSE t.vehicle_id END AS vehicle_id)
  FROM trips_kept t LEFT JOIN (SELECT route_id, min(vehicle_id) AS first FROM vehicle_pools GROUP BY 1) p ON t.route_id = p.route_id) k LEFT JOIN vehicles v ON k.vehicle_id = v.vehicle_id"""
VIEWS["clean_trips"] = """
SELECT trip_id, t.route_id, vehicle_id, coalesce(capacity, 80) AS capacity, CAST(CAST(scheduled_departure AS DATE) AS VARCHAR) AS date,
  greatest(least(coalesce(departure_delay_min, (SELECT quantile_cont(departure_delay_min, 0.5) FROM trips_vehicled)), 120), -5) AS departure_delay_min,
  greatest(least(coalesce(occupancy_max_pct, m.med, 0), 200), 0) AS occupancy_max_pct,
  greatest(least(coalesce(occupancy_avg_pct, (SELECT quantile_cont(occupancy_avg_pct, 0.5) FROM trips_vehicled), 0), 200), 0) AS occupancy_avg_pct,
  greatest(least(boardings, 400), 0) AS boardings, greatest(least(alightings, 400), 0) AS alightings,
  CASE day_type WHEN 'wknd' THEN 'weekend' WHEN 'holliday' THEN 'holiday' ELSE day_type END AS day_type,
  CASE weather WHEN 'rainy' THEN 'rain' WHEN 'clearr' THEN 'clear' WHEN 'thunderstorm' THEN 'storm' WHEN 'fog' THEN 'clear' ELSE weather END AS weather,
  greatest(least(coalesce(departure_delay_min, (SELECT quantile_cont(departure_delay_min, 0.5) FROM trips_vehicled)), 120), -5) <= 5 AS on_time
FROM trips_vehicled t LEFT JOIN (SELECT route_id, quantile_cont(occupancy_max_pct, 0.5) AS med FROM trips_vehicled GROUP BY 1) m ON t.route_id = m.route_id"""
VIEWS["visits_first"] = """
SELECT * FROM raw_visits QUALIFY row_number() OVER (PARTITION BY trip_id, seq ORDER BY stop_ref_order, visit_ref, arr_delay_min NULLS FIRST, boarded) = 1"""
VIEWS["visits_kept"] = f"""
SELECT v.* REPLACE (a.canonical AS stop_id, coalesce(try_cast(actual_arrival AS TIMESTAMP), try_cast(scheduled_arrival AS TIMESTAMP)) AS actual_arrival,
  CASE WHEN try_cast(arr_delay_min AS DOUBLE) IS NOT NULL THEN greatest(least(try_cast(arr_delay_min AS DOUBLE), 160), -10) END AS arr_delay_min, greatest(least(boarded, 300), 0) AS boarded, greatest(least(coalesce(alighted, 0), 300), 0) AS alighted)
FROM visits_first v JOIN (SELECT {alias('stop_id')} AS k, min(stop_id) AS canonical FROM stop_names GROUP BY 1) a ON {alias('v.stop_id')} = a.k
WHERE trip_id IN (SELECT trip_id FROM valid_trips) AND coalesce(try_cast(actual_arrival AS TIMESTAMP), try_cast(scheduled_arrival AS TIMESTAMP)) IS NOT NULL"""
VIEWS["visits_balanced"] = """
SELECT v.* EXCLUDE (arr_delay_min), CASE WHEN try_cast(arr_delay_min AS DOUBLE) IS NULL THEN coalesce(quantile_cont(arr_delay_min, 0.5) OVER (PARTITION BY trip_id), 0) ELSE arr_delay_min END AS arr_delay_min,
  greatest(least(sum(boarded - alighted) OVER (PARTITION BY trip_id ORDER BY seq), 500), 0) AS onboard_after FROM visits_kept v"""
VIEWS["clean_visits"] = """
SELECT b.trip_id, b.seq, b.stop_id, b.arr_delay_min, b.boarded, b.alighted, b.onboard_after, b.onboard_after/greatest(coalesce(t.capacity, 80), 1) AS occupancy_after
FROM visits_balanced b LEFT JOIN valid_trips t ON b.trip_id = t.trip_id"""
VIEWS["tickets_first"] = """
SELECT * FROM raw_tickets QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY part_ref, alighting_ref, fare_order, distance_order) = 1"""
VIEWS["tickets_kept"] = """
SELECT k.* REPLACE (t.route_id AS route_id, try_cast(boarding_datetime AS TIMESTAMP) AS boarding_datetime, try_cast(alighting_datetime AS TIMESTAMP) AS alighting_datetime,
  try_cast(distance_km AS DOUBLE) AS distance_km, try_cast(fare AS DOUBLE) AS fare), k.route_id AS own_route
FROM tickets_first k JOIN valid_trips t ON k.trip_id = t.trip_id"""
VIEWS["tickets_timed"] = "SELECT * FROM tickets_kept WHERE boarding_datetime IS NOT NULL AND alighting_datetime IS NOT NULL AND alighting_datetime > boarding_datetime"
VIEWS["clean_tickets"] = """
SELECT ticket_id, trip_id, route_id, passenger_id, distance_km, greatest(least(coalesce(fare, (18 + 4.2e0*distance_km)*discount), 1000), 0.1e0) AS fare, travel_min,
  CASE WHEN pass_type IN ('single', 'day', 'weekly', 'monthly') THEN pass_type ELSE 'single' END AS pass_type FROM (
  SELECT t.* REPLACE (greatest(least(coalesce(distance_km, m.med), 100), 0.1e0) AS distance_km, greatest(least(travel_min, 300), 0.1e0) AS travel_min),
    CASE pass_type WHEN 'day' THEN 0.75e0 WHEN 'weekly' THEN 0.5e0 WHEN 'monthly' THEN 0.35e0 ELSE 1e0 END AS discount
  FROM tickets_timed t LEFT JOIN (SELECT route_id, quantile_cont(distance_km, 0.5) AS med FROM tickets_timed GROUP BY 1) m ON t.route_id = m.route_id)
WHERE passenger_id IS NOT NULL"""
