"""Feature operators (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X
from headwise.functions.scans import micros_chunk
from headwise.operators import features as Fe
from headwise.plans import frames
from headwise.plans.catalog import query
from headwise.plans.oracle import BUNCHED, SEASON, VALID
from headwise.sources import star

ORDER = ["us", "trip_id"]
DELAY = "departure_delay_min"


def cyc(c: str, period: int, name: str) -> str:
    theta = f"2*pi()*{c}/{period}e0"
    return f"sin({theta}) AS {name}_sin, cos({theta}) AS {name}_cos"


def code(c: str, codes: dict, name: str | None = None, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CASE {c} {whens} ELSE {default} END AS {name or c + '_code'}"


def prior(keys: str, prefix: str, cols: str = "mean,std,count") -> str:
    w = f"(PARTITION BY {keys} ORDER BY us, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = {
        "mean": f"avg({DELAY}) OVER {w} AS {prefix}_mean",
        "std": f"stddev_pop({DELAY}) OVER {w} AS {prefix}_std",
        "count": f"count(*) OVER {w} AS {prefix}_count",
    }
    return ", ".join(parts[c] for c in cols.split(","))


@query(
    "F01_sequence_position",
    """SELECT trip_id, seq, stop_id, 100e0*seq/m AS position_pct, CAST(seq = 1 AS INT) AS is_first, CAST(seq = m AS INT) AS is_last
    FROM (SELECT *, max(seq) OVER (PARTITION BY trip_id) AS m FROM raw_stop_visits)""",
)
def _(spark, root):
    return Fe.position_features(star.raw_stop_visits(spark, root).select("trip_id", "seq", "stop_id"), "trip_id", "seq")


@query(
    "F02_trip_features",
    f"""SELECT trip_id, route_id, vehicle_id, CAST(date AS VARCHAR) AS date, day_type, {code('day_type', S.DAY_TYPE_CODES)}, direction, CAST(is_peak AS INT) AS is_peak_int,
    hour, {cyc('hour', 24, 'hour')}, weekday, {cyc('weekday', 7, 'weekday')}, month, {cyc('month', 12, 'month')}, season, {code('season', S.SEASON_CODES)}, weather,
    {code('weather', S.WEATHER_CODES)}, time_band, {code('time_band', S.TIME_BAND_CODES)}, route_category, {code('route_category', S.ROUTE_CATEGORY_CODES)},
    vehicle_type, {code('vehicle_type', S.VEHICLE_TYPE_CODES)}, distance_km, scheduled_travel_min, scheduled_headway_min, route_length_km, capacity,
    CAST(is_weekend AS INT) AS is_weekend_int FROM trip_facts""",
)
def _(spark, root):
    return Fe.trip_features(frames.trip_facts(spark, root))


@query(
    "F03_stop_features",
    f"""SELECT trip_id, route_id, stop_id, seq, 100e0*seq/m AS position_pct, CAST(seq = 1 AS INT) AS is_first, CAST(seq = m AS INT) AS is_last, stop_name, zone,
    CAST(date AS VARCHAR) AS date, hour, {cyc('hour', 24, 'hour')}, isodow(date) - 1 AS weekday, {cyc('(isodow(date) - 1)', 7, 'weekday')}, month(date) AS month,
    {SEASON.format(m='month(date)')} AS season, {code(SEASON.format(m='month(date)'), S.SEASON_CODES, 'season_code')}, time_band, {code('time_band', S.TIME_BAND_CODES)},
    CAST(isodow(date) >= 6 AS INT) AS is_weekend_int, boarded, alighted, onboard_after FROM (SELECT *, max(seq) OVER (PARTITION BY trip_id) AS m FROM stop_facts)""",
)
def _(spark, root):
    visits = star.stop_facts(spark, root).drop("ship_date", "tax", "visit_ref")
    return Fe.stop_features(visits).drop("zone_code")


_CELLS = """
WITH cells AS (SELECT route_id, date, time_band, count(*) AS boardings, avg(fare) AS avg_fare, sum(distance_km) AS passenger_km,
  avg(distance_km) AS avg_distance_km, avg(travel_min) AS avg_travel_min FROM raw_rides GROUP BY 1, 2, 3)
"""


@query("F04_demand_cells", _CELLS + "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM cells")
def _(spark, root):
    return Fe.demand_cells(star.raw_rides(spark, root))


@query(
    "F05_row_lag_week",
    _CELLS + """SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, boardings, CAST(lag(boardings, 7) OVER (PARTITION BY route_id, time_band ORDER BY date) AS DOUBLE) AS prev_week_boardings FROM cells""",
)
def _(spark, root):
    cells = Fe.demand_cells(star.raw_rides(spark, root)).select("route_id", "date", "time_band", "boardings")
    out = Fe.row_lag(cells, ["route_id", "time_band"], "date", "boardings", 7, "prev_week_boardings")
    return out.withColumn("prev_week_boardings", F.col("prev_week_boardings").cast("double"))


@query(
    "F06_trailing_seven_row_mean",
    _CELLS + """SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, boardings, avg(boardings) OVER (PARTITION BY route_id, time_band ORDER BY date
    ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7d_boardings FROM cells""",
)
def _(spark, root):
    cells = Fe.demand_cells(star.raw_rides(spark, root)).select("route_id", "date", "time_band", "boardings")
    return Fe.row_rolling_mean(cells, ["route_id", "time_band"], "date", "boardings", 7, "rolling_7d_boardings")


@query(
    "F04_demand_features",
    _CELLS + f"""SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, boardings, avg_fare, passenger_km, avg_distance_km, avg_travel_min,
    CAST(lag(boardings, 7) OVER w AS DOUBLE) AS prev_week_boardings, avg(boardings) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7d_boardings,
    isodow(date) - 1 AS weekday, month(date) AS month, {SEASON.format(m='month(date)')} AS season, {code(SEASON.format(m='month(date)'), S.SEASON_CODES, 'season_code')},
    {code('time_band', S.TIME_BAND_CODES)}, {cyc('(isodow(date) - 1)', 7, 'weekday')}, {cyc('month(date)', 12, 'month')}
    FROM cells WINDOW w AS (PARTITION BY route_id, time_band ORDER BY date)""",
)
def _(spark, root):
    out = Fe.demand_features(star.raw_rides(spark, root))
    return out.withColumn("prev_week_boardings", F.col("prev_week_boardings").cast("double"))


@query(
    "F08_scheduled_supply",
    """SELECT q.route_id, CAST(q.date AS VARCHAR) AS date, q.trips_total, coalesce(t.n, 0) AS trips_scheduled, ln(1 + coalesce(t.n, 0)) AS log_trips_scheduled
    FROM quality_days q LEFT JOIN (SELECT route_id, date, count(*) AS n FROM trips_core WHERE is_peak GROUP BY 1, 2) t ON q.route_id = t.route_id AND q.date = t.date""",
)
def _(spark, root):
    trips = star.trips_core(spark, root)
    days = trips.groupBy("route_id", "date").agg(F.count(F.lit(1)).alias("trips_total"))
    return Fe.supply_counts(days, trips.where("is_peak"), ["route_id", "date"])


@query(
    "F09_calendar_date_lags",
    _CELLS + "SELECT c.route_id, CAST(c.date AS VARCHAR) AS date, c.time_band, c.boardings"
    + "".join(f", CAST(l{d}.boardings AS DOUBLE) AS lag{d}_boardings" for d in (1, 2, 7, 14)) + " FROM cells c "
    + " ".join(f"LEFT JOIN cells l{d} ON l{d}.route_id = c.route_id AND l{d}.time_band = c.time_band AND l{d}.date = c.date - {d}" for d in (1, 2, 7, 14)),
)
def _(spark, root):
    cells = Fe.demand_cells(star.raw_rides(spark, root)).select("route_id", "date", "time_band", "boardings")
    out = Fe.calendar_lags(cells, ["route_id", "time_band"], "date", "boardings")
    return out.withColumns({f"lag{d}_boardings": F.col(f"lag{d}_boardings").cast("double") for d in (1, 2, 7, 14)})


def _range(days: int) -> str:
    return f"(PARTITION BY route_id, time_band ORDER BY date RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@query(
    "F10_calendar_window_stats",
    _CELLS + f"""SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, boardings, avg(boardings) OVER {_range(7)} AS roll7_mean_boardings,
    quantile_cont(CAST(boardings AS DOUBLE), 0.5) OVER {_range(7)} AS roll7_median_boardings, stddev_pop(boardings) OVER {_range(7)} AS roll7_std_boardings,
    avg(boardings) OVER {_range(28)} AS roll28_mean_boardings FROM cells""",
)
def _(spark, root):
    cells = Fe.demand_cells(star.raw_rides(spark, root)).select("route_id", "date", "time_band", "boardings")
    return Fe.calendar_windows(cells, ["route_id", "time_band"], "date", "boardings")


@query(
    "F11_static_route_attributes",
    f"""SELECT d.route_id, CAST(d.date AS VARCHAR) AS date, d.passengers, {code('r.category', S.ROUTE_CATEGORY_CODES, 'route_category_code', '-1')},
    r.length_km AS route_length_km, r.stops_count AS route_stops_count FROM daily_demand d LEFT JOIN routes r ON d.route_id = r.route_id""",
)
def _(spark, root):
    daily = frames.daily_demand(spark, root).select("route_id", "date", "passengers")
    return Fe.static_attributes(daily, star.routes(spark, root))


def _core(spark, root):
    return star.trips_core(spark, root).select("trip_id", "route_id", "vehicle_id", "date", "us", DELAY)


@query("F12_prior_stats_route", f"SELECT trip_id, {prior('route_id', 'route_prior_delay')} FROM trips_core")
def _(spark, root):
    out = Fe.prior_stats(_core(spark, root), ["route_id"], DELAY, "route_prior_delay", ORDER, micros_chunk("us"))
    return out.select("trip_id", "route_prior_delay_mean", "route_prior_delay_std", "route_prior_delay_count")


@query("F13_prior_stats_network_day", f"SELECT trip_id, {prior('date', 'network_prior_delay')} FROM trips_core")
def _(spark, root):
    out = Fe.prior_stats(_core(spark, root), ["date"], DELAY, "network_prior_delay", ORDER, micros_chunk("us", 15))
    return out.select("trip_id", "network_prior_delay_mean", "network_prior_delay_std", "network_prior_delay_count")


@query("F13_prior_stats_vehicle", f"SELECT trip_id, {prior('vehicle_id', 'vehicle_prior_delay')} FROM trips_core")
def _(spark, root):
    out = Fe.prior_stats(_core(spark, root), ["vehicle_id"], DELAY, "vehicle_prior_delay", ORDER, micros_chunk("us", 1440))
    return out.select("trip_id", "vehicle_prior_delay_mean", "vehicle_prior_delay_std", "vehicle_prior_delay_count")


_W = "(PARTITION BY {k} ORDER BY us, trip_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(
    "F14_prior_maximum",
    f"SELECT trip_id, max({DELAY}) OVER {_W.format(k='route_id, date', n='UNBOUNDED')} AS route_date_prior_delay_max FROM trips_core",
)
def _(spark, root):
    out = Fe.prior_max(_core(spark, root), ["route_id", "date"], DELAY, "route_date_prior_delay_max", ORDER, micros_chunk("us"))
    return out.select("trip_id", "route_date_prior_delay_max")


@query(
    "F15_prior_flag_share",
    f"SELECT trip_id, avg(CAST({DELAY} <= 5 AS INT)) OVER {_W.format(k='route_id', n='UNBOUNDED')} AS route_prior_on_time_rate FROM trips_core",
)
def _(spark, root):
    out = Fe.prior_rate(_core(spark, root), ["route_id"], F.col(DELAY) <= 5, "route_prior_on_time_rate", ORDER, micros_chunk("us"))
    return out.select("trip_id", "route_prior_on_time_rate")


@query(
    "F16_rolling_previous_rows",
    f"SELECT trip_id, avg({DELAY}) OVER {_W.format(k='route_id', n=7)} AS rolling7, avg({DELAY}) OVER {_W.format(k='route_id', n=28)} AS rolling28 FROM trips_core",
)
def _(spark, root):
    out = Fe.rolling_prior_means(_core(spark, root), ["route_id"], DELAY, {"rolling7": 7, "rolling28": 28}, ORDER, micros_chunk("us"))
    return out.select("trip_id", "rolling7", "rolling28")


@query(
    "F17_normal_p90_proxy",
    f"SELECT trip_id, m + 1.2816e0*s AS route_prior_delay_p90 FROM (SELECT trip_id, avg({DELAY}) OVER w AS m, stddev_pop({DELAY}) OVER w AS s FROM trips_core WINDOW w AS {_W.format(k='route_id', n='UNBOUNDED')})",
)
def _(spark, root):
    out = Fe.prior_stats(_core(spark, root), ["route_id"], DELAY, "p", ORDER, micros_chunk("us"))
    return out.select("trip_id", Fe.p90_proxy("p_mean", "p_std").alias("route_prior_delay_p90"))


@query(
    "F18_headway_pressure",
    "SELECT trip_id, coalesce(avg(scheduled_headway_min) OVER (PARTITION BY route_id)/nullif(scheduled_headway_min, 0), 1e0) AS headway_pressure FROM trips",
)
def _(spark, root):
    return Fe.headway_pressure(star.trips(spark, root), ["route_id"], "scheduled_headway_min").select("trip_id", "headway_pressure")


_HISTORY_KEYS = [
    "trip_id", "route_id", "day_type_code", "weather_code", "season_code", "time_band_code", "route_category_code", "vehicle_type_code",
    "is_peak_int", "is_weekend_int", "is_holiday_int", "minute_of_day", "snow_int", "storm_int", "severe_weather_int", "days_since_holiday",
    "minute_of_day_sin", "minute_of_day_cos", "precip_mm", "temp_c", "headway_pressure", "event_demand_mult", "event_extra_delay", "has_event",
    "route_date_prior_delay_mean", "route_date_prior_delay_std", "route_date_prior_trip_count", "route_date_prior_delay_max",
    "route_date_peak_prior_delay_mean", "vehicle_date_prior_delay_mean", "network_prior_delay_mean", "network_prior_trip_count",
    "vehicle_prior_delay_mean", "route_prior_delay_mean", "route_prior_delay_std", "route_prior_delay_count", "route_prior_delay_p90",
    "route_timeband_prior_delay_mean", "route_weather_prior_delay_mean", "route_prior_delay_rolling7", "route_prior_delay_rolling28",
    "route_prior_on_time_rate", "route_prior_moderate_plus_rate",
]


def _u(k: str) -> str:
    return _W.format(k=k, n="UNBOUNDED")


HISTORY_SQL = f"""
SELECT t.trip_id, t.route_id, {code('day_type', S.DAY_TYPE_CODES, default='0')}, {code('weather', S.WEATHER_CODES, default='0')}, {code('season', S.SEASON_CODES, default='0')},
  {code('time_band', S.TIME_BAND_CODES, default='0')}, {code('route_category', S.ROUTE_CATEGORY_CODES, default='0')}, {code('vehicle_type', S.VEHICLE_TYPE_CODES, default='0')},
  CAST(is_peak AS INT) AS is_peak_int, CAST(is_weekend AS INT) AS is_weekend_int, CAST(c.is_holiday AS INT) AS is_holiday_int,
  hour*60 + minute(scheduled_departure) AS minute_of_day, CAST(weather = 'snow' AS INT) AS snow_int, CAST(weather = 'storm' AS INT) AS storm_int,
  CAST(weather IN ('snow', 'storm') OR c.precip_mm > 10 OR c.temp_c < 0 AS INT) AS severe_weather_int,
  coalesce(CAST(t.date - (SELECT max(h.date) FROM trip_calendar h WHERE h.is_holiday AND h.date < t.date) AS DOUBLE), 365e0) AS days_since_holiday,
  {cyc('(hour*60 + minute(scheduled_departure))', 1440, 'minute_of_day')}, c.precip_mm, c.temp_c,
  coalesce(avg(scheduled_headway_min) OVER (PARTITION BY t.route_id)/nullif(scheduled_headway_min, 0), 1e0) AS headway_pressure,
  coalesce(e.m, 1e0) AS event_demand_mult, coalesce(e.x, 0e0) AS event_extra_delay, CAST(coalesce(e.x, 0e0) > 0 AS INT) AS has_event,
  avg({DELAY}) OVER {_u('t.route_id, t.date')} AS route_date_prior_delay_mean, stddev_pop({DELAY}) OVER {_u('t.route_id, t.date')} AS route_date_prior_delay_std,
  count(*) OVER {_u('t.route_id, t.date')} AS route_date_prior_trip_count, max({DELAY}) OVER {_u('t.route_id, t.date')} AS route_date_prior_delay_max,
  avg({DELAY}) OVER {_u('t.route_id, t.date, is_peak')} AS route_date_peak_prior_delay_mean, avg({DELAY}) OVER {_u('vehicle_id, t.date')} AS vehicle_date_prior_delay_mean,
  avg({DELAY}) OVER {_u('t.date')} AS network_prior_delay_mean, count(*) OVER {_u('t.date')} AS network_prior_trip_count,
  avg({DELAY}) OVER {_u('vehicle_id')} AS vehicle_prior_delay_mean, avg({DELAY}) OVER {_u('t.route_id')} AS route_prior_delay_mean,
  stddev_pop({DELAY}) OVER {_u('t.route_id')} AS route_prior_delay_std, count(*) OVER {_u('t.route_id')} AS route_prior_delay_count,
  avg({DELAY}) OVER {_u('t.route_id')} + 1.2816e0*stddev_pop({DELAY}) OVER {_u('t.route_id')} AS route_prior_delay_p90,
  avg({DELAY}) OVER {_u('t.route_id, time_band')} AS route_timeband_prior_delay_mean, avg({DELAY}) OVER {_u('t.route_id, weather')} AS route_weather_prior_delay_mean,
  avg({DELAY}) OVER {_W.format(k='t.route_id', n=7)} AS route_prior_delay_rolling7, avg({DELAY}) OVER {_W.format(k='t.route_id', n=28)} AS route_prior_delay_rolling28,
  avg(CAST({DELAY} <= 5 AS INT)) OVER {_u('t.route_id')} AS route_prior_on_time_rate, avg(CAST({DELAY} > 9 AS INT)) OVER {_u('t.route_id')} AS route_prior_moderate_plus_rate
FROM trip_facts t LEFT JOIN trip_calendar c ON t.date = c.date LEFT JOIN (SELECT z.route_id, v.date, arg_max(v.demand_multiplier, v.ordinal) AS m,
  arg_max(v.extra_delay_min, v.ordinal) AS x FROM route_zones z JOIN trip_events v ON z.zone = v.zone GROUP BY 1, 2) e ON t.route_id = e.route_id AND t.date = e.date
"""


@query("F19_trip_history_frame", HISTORY_SQL)
def _(spark, root):
    return frames.history(spark, root).select(*_HISTORY_KEYS)


@query(
    "F20_occupancy_features",
    f"""WITH cells AS (SELECT route_id, date, time_band, avg(occupancy_max_pct) AS occupancy_max_pct, avg(occupancy_avg_pct) AS occupancy_avg_pct,
      CAST(sum(boardings) AS BIGINT) AS boardings FROM trips_core GROUP BY 1, 2, 3)
    SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, occupancy_max_pct, occupancy_avg_pct, boardings, lag(occupancy_max_pct, 7) OVER w AS prev_week_occupancy_max,
      avg(occupancy_max_pct) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7d_occupancy_max, isodow(date) - 1 AS weekday, month(date) AS month,
      {SEASON.format(m='month(date)')} AS season, {code(SEASON.format(m='month(date)'), S.SEASON_CODES, 'season_code')}, {code('time_band', S.TIME_BAND_CODES)},
      CAST(isodow(date) >= 6 AS INT) AS is_weekend_int, {cyc('(isodow(date) - 1)', 7, 'weekday')} FROM cells WINDOW w AS (PARTITION BY route_id, time_band ORDER BY date)""",
)
def _(spark, root):
    return Fe.occupancy_features(star.trips_core(spark, root))


_SERIES = {"avg_delay_min": "delay", "on_time_share": "on_time", "p90_delay_min": "p90"}
DELAY_FEATURES_SQL = (
    f"""WITH cells AS (SELECT route_id, date, time_band, avg({DELAY}) AS avg_delay_min, avg(CAST(on_time AS INT)) AS on_time_share, avg(scheduled_headway_min) AS avg_headway_min,
  stddev_samp(scheduled_headway_min) AS headway_std_min, arg_min(weather, (us, trip_id)) AS weather, arg_min(direction, (us, trip_id)) AS direction,
  quantile_cont({DELAY}, 0.9) AS p90_delay_min FROM trips GROUP BY 1, 2, 3),
rate AS (SELECT route_id, count(*) FILTER (WHERE {BUNCHED})/greatest(count(*) FILTER (WHERE {VALID}), 1) AS route_bunching_rate FROM trips GROUP BY 1)
SELECT c.*, r.route_bunching_rate FROM (SELECT * REPLACE (CAST(date AS VARCHAR) AS date), headway_std_min/nullif(avg_headway_min, 0) AS headway_cv"""
    + "".join(f", lag({c}, {n}) OVER w AS {s}_lag_{n}" for c, s in _SERIES.items() for n in (1, 7, 14))
    + "".join(
        f", avg({c}) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {s}_rolling_{n}" for c, s in _SERIES.items() for n in (7, 14, 28)
    )
    + " FROM cells WINDOW w AS (PARTITION BY route_id, time_band ORDER BY date)) c LEFT JOIN rate r ON c.route_id = r.route_id"
)


@query("F21_delay_features", DELAY_FEATURES_SQL)
def _(spark, root):
    return Fe.delay_features(star.trips(spark, root))


@query(
    "F22_hierarchical_fill",
    """WITH d AS (SELECT route_id, date, avg(scheduled_headway_min) AS h, stddev_samp(scheduled_headway_min) AS s FROM trips GROUP BY 1, 2),
    fit AS (SELECT * FROM d WHERE date <= (SELECT max(date) FROM d) - 7)
    SELECT d.route_id, CAST(d.date AS VARCHAR) AS date, coalesce(d.h, g.h, (SELECT avg(h) FROM fit)) AS h, coalesce(d.s, g.s, (SELECT avg(s) FROM fit)) AS s
    FROM d LEFT JOIN (SELECT route_id, avg(h) AS h, avg(s) AS s FROM fit GROUP BY 1) g ON d.route_id = g.route_id""",
)
def _(spark, root):
    d = star.trips(spark, root).groupBy("route_id", "date").agg(
        F.avg("scheduled_headway_min").alias("h"), F.stddev_samp("scheduled_headway_min").alias("s")
    )
    train = d.where(F.col("date") <= F.date_sub(d.agg(F.max("date")).scalar(), 7))
    return Fe.hierarchical_fill(d, train, ["route_id"], ["h", "s"])


@query(
    "F23_gap_to_previous_departure",
    "SELECT trip_id, (us - lag(us) OVER (PARTITION BY route_id, date, direction ORDER BY us, trip_id))/6e7 AS gap_min FROM trips_core",
)
def _(spark, root):
    core = star.trips_core(spark, root)
    keys = ["route_id", "date", "direction"]
    return Fe.gap_to_previous(core, keys, "us", "trip_id", micros_chunk("us"), "gap_min").select("trip_id", "gap_min")


@query(
    "F24_shrunk_group_effects",
    f"""WITH fit AS (SELECT * FROM trips_core WHERE date <= (SELECT max(date) FROM trips_core) - 7), g AS (SELECT avg({DELAY}) AS m FROM fit),
    r0 AS (SELECT *, {DELAY} - (SELECT m FROM g) AS res FROM fit), e1 AS (SELECT route_id, sum(res)/(count(res) + 5e0) AS e FROM r0 GROUP BY 1),
    r1 AS (SELECT r0.* EXCLUDE (res), r0.res - coalesce(e1.e, 0) AS res FROM r0 LEFT JOIN e1 ON r0.route_id = e1.route_id),
    e2 AS (SELECT date, sum(res)/(count(res) + 5e0) AS e FROM r1 GROUP BY 1),
    r2 AS (SELECT r1.* EXCLUDE (res), r1.res - coalesce(e2.e, 0) AS res FROM r1 LEFT JOIN e2 ON r1.date = e2.date),
    e3 AS (SELECT vehicle_id, sum(res)/(count(res) + 5e0) AS e FROM r2 GROUP BY 1)
    SELECT t.trip_id, coalesce(e1.e, 0) AS route_id_effect, coalesce(e2.e, 0) AS date_effect, coalesce(e3.e, 0) AS vehicle_id_effect,
      (SELECT m FROM g) + coalesce(e1.e, 0) + coalesce(e2.e, 0) + coalesce(e3.e, 0) AS signal,
      {DELAY} - ((SELECT m FROM g) + coalesce(e1.e, 0) + coalesce(e2.e, 0) + coalesce(e3.e, 0)) AS residual
    FROM trips_core t LEFT JOIN e1 ON t.route_id = e1.route_id LEFT JOIN e2 ON t.date = e2.date LEFT JOIN e3 ON t.vehicle_id = e3.vehicle_id""",
)
def _(spark, root):
    core = _core(spark, root)
    train = core.where(F.col("date") <= F.date_sub(core.agg(F.max("date")).scalar(), 7))
    out = Fe.shrunk_effects(core, train, DELAY, ["route_id", "date", "vehicle_id"], 5.0)
    return out.select("trip_id", "route_id_effect", "date_effect", "vehicle_id_effect", "signal", "residual")


def backfit_sql(groups, rounds: int, fit: str) -> str:
    """Simultaneous effects: each round's table of a grouping reads the newest of the others, shifted between rounds."""
    out, newest = [f"fit AS ({fit})", f"g AS (SELECT avg({DELAY}) AS m FROM fit)"], {}
    for r in range(rounds):
        for c in groups:
            others = [h for h in groups if h != c and h in newest]
            less = "".join(f" - coalesce({newest[h]}.e, 0)" for h in others)
            joins = "".join(f" LEFT JOIN {newest[h]} ON fit.{h} = {newest[h]}.{h}" for h in others)
            name = f"{c}_{r}"
            out.append(f"{name} AS (SELECT fit.{c}, sum({DELAY} - (SELECT m FROM g){less})/(count({DELAY}) + 5e0) AS e FROM fit{joins} GROUP BY 1)")
            newest[c] = name
        if r + 1 < rounds:
            means = " + ".join(f"(SELECT avg(e) FROM {c}_{r})" for c in groups)
            parts = " + ".join(f"(SELECT 1e0/count(*) FROM {c}_{r})" for c in groups)
            out.append(f"s_{r} AS (SELECT ({means})/({parts}) AS l)")
            for c in groups:
                out.append(f"{c}_{r}s AS (SELECT {c}, e + (SELECT l FROM s_{r})/(SELECT count(*) FROM {c}_{r}) - (SELECT avg(e) FROM {c}_{r}) AS e FROM {c}_{r})")
                newest[c] = f"{c}_{r}s"
    total = "".join(f" + coalesce({newest[c]}.e, 0)" for c in groups)
    shown = ", ".join(f"coalesce({newest[c]}.e, 0) AS {c}_effect" for c in groups)
    joins = "".join(f" LEFT JOIN {newest[c]} ON t.{c} = {newest[c]}.{c}" for c in groups)
    return f"""WITH {", ".join(out)} SELECT t.trip_id, {shown}, (SELECT m FROM g){total} AS signal, {DELAY} - ((SELECT m FROM g){total}) AS residual
    FROM trips_core t{joins}"""


@query("F24_backfitted_group_effects", backfit_sql(["route_id", "date", "vehicle_id"], 3, "SELECT * FROM trips_core WHERE date <= (SELECT max(date) FROM trips_core) - 7"))
def _(spark, root):
    core = _core(spark, root)
    train = core.where(F.col("date") <= F.date_sub(core.agg(F.max("date")).scalar(), 7))
    out = Fe.backfitted_effects(core, train, DELAY, ["route_id", "date", "vehicle_id"], 5.0, rounds=3, tolerance=0.0)
    return out.select("trip_id", "route_id_effect", "date_effect", "vehicle_id_effect", "signal", "residual")


@query(
    "F26_training_frame",
    _CELLS + """SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, CAST(prev_week_boardings AS DOUBLE) AS prev_week_boardings, rolling_7d_boardings, weekday, target FROM (
    SELECT route_id, date, time_band, lag(boardings, 7) OVER w AS prev_week_boardings, avg(boardings) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7d_boardings,
    isodow(date) - 1 AS weekday, boardings AS target FROM cells WINDOW w AS (PARTITION BY route_id, time_band ORDER BY date)) WHERE prev_week_boardings IS NOT NULL""",
)
def _(spark, root):
    d = Fe.demand_features(star.raw_rides(spark, root)).withColumnRenamed("boardings", "volume")
    d = d.withColumn("prev_week_boardings", F.col("prev_week_boardings").cast("double"))
    keys = ["route_id", "date", "time_band"]
    return Fe.training_frame(d, keys, ["prev_week_boardings", "rolling_7d_boardings", "weekday"], "volume")


@query(
    "F07_feature_manifest",
    """SELECT 'trip_features' AS frame, count(*) AS rows, 33 AS n_columns FROM events UNION ALL SELECT 'stop_features', count(*), 24 FROM lineitem""",
)
def _(spark, root):
    manifest = Fe.feature_manifest(
        {
            "trip_features": Fe.trip_features(frames.trip_facts(spark, root)),
            "stop_features": Fe.stop_features(star.stop_facts(spark, root).drop("zone")),
        }
    )
    return manifest.drop("columns")
