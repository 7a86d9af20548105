"""Report tables (P), run-log tables (L), geographic tables (G) and profiles (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwise.functions import scalars as X
from headwise.operators import aggregates as A
from headwise.operators import features as Fe
from headwise.operators import rollups as P
from headwise.plans import frames, model_queries
from headwise.plans.catalog import query
from headwise.plans.feature_queries import backfit_sql
from headwise.plans.frames import Layer
from headwise.plans.oracle import VIEWS
from headwise.session import materialise
from headwise.sources import star

VIEWS["run_log"] = """
SELECT event_id, ts, event_type AS action, 'component-' || CAST(user_id % 7 AS VARCHAR) AS component,
  CASE WHEN value > 60 THEN 'failed' WHEN value > 50 THEN 'warning' WHEN k = 7 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN k <> 0 THEN value*10 END AS duration_ms
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
DELAY = "departure_delay_min"


@query("P01_value_counts", "SELECT severity, time_band, count(*) AS count FROM overcrowding_events GROUP BY 1, 2")
def _(spark, root):
    return P.value_counts(A.overcrowding_events(star.trips_core(spark, root)), "severity", "time_band")


@query("P02_city_daily_totals", "SELECT CAST(date AS VARCHAR) AS date, CAST(sum(passengers) AS BIGINT) AS passengers FROM daily_demand GROUP BY 1")
def _(spark, root):
    return P.daily_totals(frames.daily_demand(spark, root))


@query("P02_daily_total_summary", "SELECT avg(p) AS avg_daily, CAST(max(p) AS BIGINT) AS peak_daily FROM (SELECT sum(passengers) AS p FROM daily_demand GROUP BY date)")
def _(spark, root):
    return P.daily_total_summary(frames.daily_demand(spark, root))


@query("P03_weekday_vs_weekend", "SELECT CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END AS day_kind, avg(passengers) AS avg_passengers FROM daily_demand GROUP BY 1")
def _(spark, root):
    return P.weekday_weekend(frames.daily_demand(spark, root))


_DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]


@query(
    "P04_route_date_matrix",
    "SELECT route_id, " + ", ".join(f"coalesce(avg(CASE WHEN date = DATE '{d}' THEN quality_score END), 0) AS \"{d}\"" for d in _DAYS)
    + " FROM quality_days WHERE route_id IN (SELECT route_id FROM quality_days GROUP BY 1 ORDER BY sum(quality_score) DESC, route_id LIMIT 15) GROUP BY 1",
)
def _(spark, root):
    return P.entity_date_matrix(A.quality_days(star.trips_core(spark, root)), "route_id", "quality_score", _DAYS, agg="avg")


@query(
    "P05_mean_band_share",
    "SELECT time_band, avg(band_share) AS avg_share, CASE time_band WHEN 'night' THEN 0 WHEN 'morning peak' THEN 1 WHEN 'midday' THEN 2 ELSE 3 END AS band_order FROM band_shares GROUP BY 1",
)
def _(spark, root):
    return P.band_means(A.band_shares(star.raw_rides(spark, root)))


@query("P05_primary_peak_counts", "SELECT primary_peak, count(DISTINCT route_id) AS routes FROM peak_patterns GROUP BY 1")
def _(spark, root):
    return P.primary_peak_counts(A.peak_patterns(star.raw_rides(spark, root)))


@query("P06_anomaly_counts", "SELECT route_id, anomaly_type, count(*) AS count FROM anomalies GROUP BY 1, 2")
def _(spark, root):
    return P.anomaly_counts(A.anomalies(frames.daily_demand(spark, root)))


@query("P06_strongest_anomalies", "SELECT route_id, CAST(date AS VARCHAR) AS date, z_score, anomaly_type FROM anomalies ORDER BY abs(z_score) DESC, route_id, date")
def _(spark, root):
    return P.strongest_anomalies(A.anomalies(frames.daily_demand(spark, root))).select("route_id", "date", "z_score", "anomaly_type")


@query(
    "P07_delay_profile_class",
    """SELECT route_id, CASE WHEN severe_critical_share > 0.3e0 THEN 'Critical' WHEN severe_critical_share > 0.15e0 THEN 'High' WHEN avg_delay_min > 10 THEN 'Moderate'
    WHEN on_time_share < 0.75e0 THEN 'Degraded' ELSE 'Good' END AS severity_profile FROM route_base""",
)
def _(spark, root):
    return P.delay_profile_class(Layer(spark, root)["route_metrics"]).select("route_id", "severity_profile")


@query("P08_city_quality_trend", "SELECT CAST(date AS VARCHAR) AS date, avg(quality_score) AS quality_score, avg(on_time_share) AS on_time_share, avg(avg_delay_min) AS avg_delay_min FROM quality_days GROUP BY 1")
def _(spark, root):
    return P.quality_trend(A.quality_days(star.trips_core(spark, root)))


@query(
    "P09_capacity_pressure",
    """SELECT pressure, count(*) AS count FROM (SELECT CASE WHEN occupancy_max_pct >= 100 OR crowding_share > 0.3e0 THEN 'Critical Pressure' WHEN occupancy_max_pct >= 85 OR crowding_share > 0.2e0 THEN 'High Pressure'
    WHEN underutilized_share > 0.5e0 THEN 'Underutilized' WHEN occupancy_max_pct >= 70 THEN 'Moderate Pressure' ELSE 'Normal' END AS pressure FROM route_base) GROUP BY 1""",
)
def _(spark, root):
    return P.value_counts(P.pressure_class(Layer(spark, root)["route_metrics"]), "pressure")


@query("P10_bottlenecks_by_zone", "SELECT zone, count(*) AS count FROM stop_metrics WHERE is_bottleneck GROUP BY 1")
def _(spark, root):
    return P.zone_bottlenecks(frames.stop_metrics(spark, root))


@query("P10_bottleneck_threshold", "SELECT quantile_cont(bottleneck_score, 0.6) AS threshold FROM stop_scored")
def _(spark, root):
    return P.bottleneck_line(Layer(spark, root)["stop_metrics"])


@query(
    "P10_band_means_over_stops",
    """SELECT time_band, avg(d) AS avg_arr_delay, avg(c) AS crowding_share, sum(b) AS total_boardings FROM (SELECT stop_id, time_band, avg(arr_delay_min) AS d,
    avg(CAST(occupancy_after >= 0.85e0 AS INT)) AS c, sum(boarded) AS b FROM stop_facts GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, root):
    return P.stop_band_means(A.stop_time_bands(star.raw_stop_visits(spark, root).withColumn("time_band", X.time_band("hour"))))


@query(
    "P11_daily_frequency_trend",
    "SELECT CAST(date AS VARCHAR) AS date, time_period, avg(trips_per_hour) AS avg_trips_per_hour, avg(headway_reliability) AS avg_headway_reliability, CAST(sum(scheduled_trips) AS BIGINT) AS total_trips FROM frequency_analysis GROUP BY 1, 2",
)
def _(spark, root):
    return P.frequency_trend(A.frequency_analysis(star.trips(spark, root)))


@query(
    "P12_peak_ratio_with_route",
    """SELECT p.*, r.route_name, r.category FROM (SELECT route_id, count(*) FILTER (WHERE hour IN (7,8,9,16,17,18)) AS peak_freq, count(*) FILTER (WHERE hour NOT IN (7,8,9,16,17,18)) AS offpeak_freq,
    count(*) FILTER (WHERE hour IN (7,8,9,16,17,18))/nullif(count(*) FILTER (WHERE hour NOT IN (7,8,9,16,17,18)), 0) AS peak_ratio FROM trips_core GROUP BY 1) p LEFT JOIN routes r ON p.route_id = r.route_id""",
)
def _(spark, root):
    ratio = A.peak_frequency(star.trips_core(spark, root))
    return ratio.join(star.routes(spark, root).select("route_id", "route_name", "category"), "route_id", "left")


@query("P13_counts_per_day_severity", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, status, count(*) AS count FROM run_log GROUP BY 1, 2")
def _(spark, root):
    return P.daily_counts(star.run_log(spark, root), "ts", "status")


@query(
    "P14_custom_order_sort",
    "SELECT event_id, status, epoch_us(ts) AS us FROM run_log ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'warning' THEN 1 WHEN 'skipped' THEN 2 ELSE 3 END, ts DESC, event_id",
)
def _(spark, root):
    ranks = {"failed": 0, "warning": 1, "skipped": 2, "ok": 3}
    ordered = P.ordered_by_rank(star.run_log(spark, root), "status", ranks, "ts", "event_id")
    return ordered.select("event_id", "status", F.unix_micros("ts").alias("us"))


_PRED = "(SELECT route_id, date, time_band, avg({v}) OVER (PARTITION BY route_id, time_band ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS predicted FROM (SELECT route_id, date, time_band, avg({v}) AS {v} FROM trips_core GROUP BY 1, 2, 3))"


def _trailing(spark, root, value):
    """A moving-average prediction per (route, band), for the summary tables."""
    keys = ["route_id", "date", "time_band"]
    cells = star.trips_core(spark, root).groupBy(*keys).agg(F.avg(value).alias(value))
    return Fe.row_rolling_mean(cells, ["route_id", "time_band"], "date", value, 7, "predicted").where("predicted IS NOT NULL")


@query(
    "P15_occupancy_forecast_summary",
    f"SELECT count(*) AS predictions, avg(predicted) AS avg_predicted, max(predicted) AS max_predicted, count(*) FILTER (WHERE predicted >= 85) AS high_count FROM {_PRED.format(v='occupancy_max_pct')} WHERE predicted IS NOT NULL",
)
def _(spark, root):
    return P.prediction_summary(_trailing(spark, root, "occupancy_max_pct"), "predicted", 85.0)


@query(
    "P15_forecast_route_means",
    f"SELECT route_id, avg(predicted) AS predicted, avg(predicted - 12) AS lower_bound, avg(predicted + 12) AS upper_bound FROM {_PRED.format(v='occupancy_max_pct')} WHERE predicted IS NOT NULL GROUP BY 1",
)
def _(spark, root):
    pred = _trailing(spark, root, "occupancy_max_pct")
    pred = pred.withColumns({"lower_bound": F.col("predicted") - 12, "upper_bound": F.col("predicted") + 12})
    return P.prediction_means(pred, "route_id", "predicted", "lower_bound", "upper_bound")


@query(
    "P17_delay_prediction_summary",
    f"SELECT count(*) AS predictions, avg(predicted) AS avg_predicted, max(predicted) AS max_predicted, count(*) FILTER (WHERE predicted >= 15) AS high_count FROM {_PRED.format(v=DELAY)} WHERE predicted IS NOT NULL",
)
def _(spark, root):
    return P.prediction_summary(_trailing(spark, root, DELAY), "predicted", 15.0)


@query("P17_delay_route_means", f"SELECT route_id, avg(predicted) AS predicted FROM {_PRED.format(v=DELAY)} WHERE predicted IS NOT NULL GROUP BY 1")
def _(spark, root):
    return P.prediction_means(_trailing(spark, root, DELAY), "route_id", "predicted")


def _stored_forecast(spark, root):
    """The output of M12, written to the shared folder and read again."""
    return materialise(model_queries.occupancy_forecast(spark, root), "occupancy_forecast")


def _stored_delay(spark, root):
    """The output of M15, written to the shared folder and read again."""
    return materialise(model_queries.delay_prediction(spark, root), "delay_prediction")


@query("P15_stored_forecast_summary")
def _(spark, root):
    return P.prediction_summary(_stored_forecast(spark, root), "predicted", 85.0)


@query("P15_stored_forecast_route_means")
def _(spark, root):
    return P.prediction_means(_stored_forecast(spark, root), "route_id", "predicted", "lower_bound", "upper_bound")


@query("P17_stored_delay_summary")
def _(spark, root):
    return P.prediction_summary(_stored_delay(spark, root), "predicted", 15.0)


@query("P17_stored_delay_route_means")
def _(spark, root):
    return P.prediction_means(_stored_delay(spark, root), "route_id", "predicted")


# Run log ----------------------------------------------------------------------------------------------------------


@query("L02_newest_first_timeline", "SELECT event_id, epoch_us(ts) AS us, action, component, status FROM run_log WHERE action = 'click' AND status = 'ok' ORDER BY ts DESC, event_id LIMIT 200")
def _(spark, root):
    out = P.timeline(star.run_log(spark, root), action="click", status="ok", limit=200, ties=["event_id"])
    return out.select("event_id", F.unix_micros("ts").alias("us"), "action", "component", "status")


@query("L03_counts_by_action_status", "SELECT action, status, count(*) AS count FROM run_log GROUP BY 1, 2")
def _(spark, root):
    return P.value_counts(star.run_log(spark, root), "action", "status")


@query("L03_counts_by_component_status", "SELECT component, status, count(*) AS count FROM run_log GROUP BY 1, 2")
def _(spark, root):
    return P.value_counts(star.run_log(spark, root), "component", "status")


@query("L04_recent_activity", "SELECT event_id, action, status FROM run_log WHERE ts >= (SELECT max(ts) FROM run_log) - INTERVAL 24 HOUR")
def _(spark, root):
    log = star.run_log(spark, root)
    return P.recent(log, 24, log.agg(F.max("ts")).scalar()).select("event_id", "action", "status")


@query(
    "L05_success_rate_and_duration",
    "SELECT count(*) AS activities, avg(CAST(status = 'ok' AS INT))*100 AS success_rate, avg(duration_ms) AS avg_duration_ms, count(DISTINCT component) AS components FROM run_log",
)
def _(spark, root):
    return P.log_kpis(star.run_log(spark, root))


@query("L05_mean_duration_by_action", "SELECT action, avg(duration_ms)/1000 AS duration_s FROM run_log WHERE duration_ms IS NOT NULL GROUP BY 1")
def _(spark, root):
    return P.mean_duration(star.run_log(spark, root))


@query("L06_daily_component_volumes", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, component, count(*) AS count FROM run_log GROUP BY 1, 2")
def _(spark, root):
    return P.daily_counts(star.run_log(spark, root), "ts", "component")


@query("L06_weekly_volumes", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS count FROM run_log GROUP BY 1")
def _(spark, root):
    return P.weekly_counts(star.run_log(spark, root))


# Geography --------------------------------------------------------------------------------------------------------


@query(
    "G01_route_geometries",
    """SELECT route_id, string_agg(CAST(seq AS VARCHAR) || ':' || CAST(lat AS VARCHAR) || ':' || CAST(lon AS VARCHAR), '|' ORDER BY seq) AS path, count(*) AS points
    FROM route_stops r JOIN stops s ON r.stop_id = s.stop_id GROUP BY 1 HAVING count(*) >= 2""",
)
def _(spark, root):
    g = P.route_geometries(star.route_stops(spark, root), star.stops(spark, root))
    return g.select("route_id", P.path_text().alias("path"), F.size("path").cast("long").alias("points"))


_WEIGHT = "CASE WHEN max({m}) OVER () > min({m}) OVER () THEN ({m} - min({m}) OVER ())/(max({m}) OVER () - min({m}) OVER ()) ELSE 0.5e0 END"


@query("G02_weighted_points", f"SELECT s.stop_id, s.lat, s.lon, {_WEIGHT.format(m='b.boardings')} AS weight FROM stops s JOIN stop_base b ON s.stop_id = b.stop_id")
def _(spark, root):
    metrics = star.raw_stop_visits(spark, root).groupBy("stop_id").agg(F.sum("boarded").alias("boardings"))
    return P.weighted_points(star.stops(spark, root), metrics, "boardings")


@query(
    "G03_weighted_points_by_day",
    f"""SELECT CAST(date AS VARCHAR) AS date, page, count(*) AS points, sum(weight) AS weight, min(stop_id) AS first_stop FROM (SELECT date, v.stop_id % 64 AS page, v.stop_id, {_WEIGHT.format(m='v.b')} AS weight
    FROM (SELECT date, stop_id, sum(boarded) AS b FROM stop_facts GROUP BY 1, 2) v JOIN stops s ON v.stop_id = s.stop_id) GROUP BY 1, 2""",
)
def _(spark, root):
    daily = star.stop_facts(spark, root).groupBy("stop_id", "date").agg(F.sum("boarded").alias("boardings"))
    out = P.weighted_points_by_day(star.stops(spark, root), daily, "boardings")
    total = F.aggregate("points", X.dbl(0.0), lambda acc, p: acc + p["weight"])
    return out.select(
        "date", "page", F.size("points").cast("long").alias("points"), total.alias("weight"), F.col("points")[0]["stop_id"].alias("first_stop")
    )


@query("G04_map_centre", "SELECT avg(lat) AS lat, avg(lon) AS lon FROM stops")
def _(spark, root):
    return P.map_centre(star.stops(spark, root))


@query("G04_bottleneck_points", "SELECT m.stop_id, m.bottleneck_score, s.lat, s.lon FROM stop_metrics m JOIN stops s ON m.stop_id = s.stop_id WHERE m.is_bottleneck")
def _(spark, root):
    return P.bottleneck_points(frames.stop_metrics(spark, root), star.stops(spark, root))


@query(
    "G05_segment_lengths",
    """SELECT route_id, seq, stop_id, segment_km, sum(segment_km) OVER (PARTITION BY route_id ORDER BY seq) AS cumulative_km FROM (SELECT r.route_id, r.seq, r.stop_id,
    coalesce(sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lon - lag(lon) OVER w, 2))*111, 0) AS segment_km FROM route_stops r JOIN stops s ON r.stop_id = s.stop_id WINDOW w AS (PARTITION BY r.route_id ORDER BY r.seq))""",
)
def _(spark, root):
    return P.segment_lengths(star.route_stops(spark, root), star.stops(spark, root))


# Profiles ---------------------------------------------------------------------------------------------------------

_Q = {f"q{int(round(p * 100)):02d}": p for p in P.PROFILE_QUANTILES}


@query(
    "B01_numeric_profile",
    f"SELECT count({DELAY}) AS count, avg({DELAY}) AS mean, stddev_samp({DELAY}) AS std, min({DELAY}) AS min, max({DELAY}) AS max, "
    + ", ".join(f"quantile_cont({DELAY}, {p}) AS {n}" for n, p in _Q.items()) + ", "
    + ", ".join(f"avg(CAST({DELAY} <= {x} AS INT)) AS share_le_{x}" for x in (4, 5, 7)) + f", avg(CAST({DELAY} > 12 AS INT)) AS share_gt_12 FROM trips_core",
)
def _(spark, root):
    return P.numeric_profile(star.trips_core(spark, root), DELAY)


_DIMS = ("hour", "weekday", "weather", "season", "route_category", "vehicle_type", "is_peak", "day_type")


@query(
    "B02_mean_by_dimensions",
    " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, avg({DELAY}) AS mean FROM trip_facts GROUP BY {d}" for d in _DIMS),
)
def _(spark, root):
    from headwise.operators import joins as J

    facts = J.trip_facts(star.trips_core(spark, root), star.routes(spark, root), star.vehicles(spark, root))
    return P.mean_by_dimensions(facts, DELAY, _DIMS)


@query(
    "B03_squared_correlation",
    f"SELECT pow(corr({DELAY}, actual_headway_min - scheduled_headway_min), 2) AS r2_headway_deviation, pow(corr({DELAY}, occupancy_avg_pct), 2) AS r2_occupancy FROM trips",
)
def _(spark, root):
    suspects = {
        "r2_headway_deviation": F.col("actual_headway_min") - F.col("scheduled_headway_min"),
        "r2_occupancy": F.col("occupancy_avg_pct"),
    }
    return P.squared_correlations(star.trips(spark, root), DELAY, suspects)


_SETS = {"operational": (5.0, 9.0, 30.0), "balanced": (4.0, 7.0, 12.0), "status": (5.0,)}


def _case(cuts) -> str:
    whens = " ".join(f"WHEN {DELAY} <= {c} THEN 'c{i}'" for i, c in enumerate(cuts))
    return f"CASE {whens} ELSE 'c{len(cuts)}' END"


_SPLIT = "CASE WHEN date > (SELECT max(date) FROM trips_core) - 7 THEN 'test' ELSE 'train' END"


def _split(df):
    cut = F.date_sub(df.agg(F.max("date")).scalar(), 7)
    return df.withColumn("split", F.when(F.col("date") > cut, "test").otherwise("train"))


@query(
    "B04_class_counts_by_threshold_set",
    "SELECT *, count/sum(count) OVER (PARTITION BY threshold_set, split) AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS threshold_set, {_SPLIT} AS split, {_case(c)} AS class, count(*) AS count FROM trips_core GROUP BY 2, 3" for n, c in _SETS.items()) + ")",
)
def _(spark, root):
    return P.class_counts(_split(star.trips_core(spark, root)), DELAY, _SETS, "split")


@query(
    "B04_rule_confusion",
    f"SELECT {_case(_SETS['operational'])} AS actual, CASE WHEN mu <= 5 THEN 'c0' WHEN mu <= 9 THEN 'c1' WHEN mu <= 30 THEN 'c2' ELSE 'c3' END AS predicted, count(*) AS count FROM (SELECT *, boardings*0.3e0 AS mu FROM trips_core) GROUP BY 1, 2",
)
def _(spark, root):
    df = star.trips_core(spark, root).withColumn("mu", F.col("boardings") * X.dbl(0.3))
    return P.rule_confusion(df, DELAY, "mu", _SETS["operational"])


@query(
    "B04_majority_baseline",
    " UNION ALL ".join(f"SELECT {c}e0 AS cut, d AS delayed_rate, greatest(d, 1 - d) AS majority_baseline FROM (SELECT avg(CAST({DELAY} > {c} AS INT)) AS d FROM trips_core)" for c in (4.0, 5.0, 7.0)),
)
def _(spark, root):
    return P.majority_baseline(star.trips_core(spark, root), DELAY, (4.0, 5.0, 7.0))


_NULLED = ("scheduled_headway_min", "actual_headway_min", "route_category", "vehicle_type", "boardings")


@query("B05_null_shares", " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS INT)) AS null_share FROM trip_facts" for c in _NULLED))
def _(spark, root):
    return P.null_shares(frames.trip_facts(spark, root), _NULLED)


_EFFECTS_SQL = f"""WITH g AS (SELECT avg({DELAY}) AS m FROM trips_core), r0 AS (SELECT *, {DELAY} - (SELECT m FROM g) AS res FROM trips_core),
e1 AS (SELECT route_id, sum(res)/(count(res) + 5e0) AS e FROM r0 GROUP BY 1), r1 AS (SELECT r0.* EXCLUDE (res), r0.res - e1.e AS res, e1.e AS e1 FROM r0 JOIN e1 ON r0.route_id = e1.route_id),
e2 AS (SELECT date, sum(res)/(count(res) + 5e0) AS e FROM r1 GROUP BY 1), fx AS (SELECT r1.*, e2.e AS e2, CASE weather WHEN 'rain' THEN 1.5e0 WHEN 'snow' THEN 4e0 WHEN 'storm' THEN 6e0 ELSE 0e0 END AS weather_add,
(SELECT m FROM g) + r1.e1 + e2.e AS signal, {DELAY} - ((SELECT m FROM g) + r1.e1 + e2.e) AS residual FROM r1 JOIN e2 ON r1.date = e2.date)
"""


def _decomposed(spark, root):
    core = star.trips_core(spark, root).select("trip_id", "route_id", "date", "weather", DELAY)
    out = Fe.shrunk_effects(core, core, DELAY, ["route_id", "date"], 5.0)
    return out.withColumn("weather_add", X.code_of("weather", {"rain": 1.5, "snow": 4.0, "storm": 6.0}, 0.0))


@query(
    "B06_variance_shares",
    _EFFECTS_SQL + f"SELECT var_samp({DELAY}) AS var_total, var_samp(weather_add)/var_samp({DELAY}) AS weather_add_share, var_samp(signal)/var_samp({DELAY}) AS signal_share, var_samp(residual)/var_samp({DELAY}) AS residual_share FROM fx",
)
def _(spark, root):
    return P.variance_shares(_decomposed(spark, root), DELAY, ["weather_add", "signal", "residual"])


@query(
    "B06_variance_shares_backfitted",
    f"""SELECT var_samp({DELAY}) AS var_total, var_samp(route_id_effect)/var_samp({DELAY}) AS route_id_effect_share, var_samp(date_effect)/var_samp({DELAY}) AS date_effect_share,
    var_samp(signal)/var_samp({DELAY}) AS signal_share, var_samp(residual)/var_samp({DELAY}) AS residual_share
    FROM (SELECT *, signal + residual AS {DELAY} FROM ({backfit_sql(["route_id", "date"], 3, "SELECT * FROM trips_core")}))""",
)
def _(spark, root):
    core = star.trips_core(spark, root).select("route_id", "date", DELAY)
    out = Fe.backfitted_effects(core, core, DELAY, ["route_id", "date"], 5.0, rounds=3, tolerance=0.0)
    return P.variance_shares(out, DELAY, ["route_id_effect", "date_effect", "signal", "residual"])


@query("B06_residual_mean_per_route_day", _EFFECTS_SQL + "SELECT route_id, CAST(date AS VARCHAR) AS date, avg(residual) AS residual_mean, count(*) AS rows FROM fx GROUP BY 1, 2")
def _(spark, root):
    return P.residual_means(_decomposed(spark, root), ["route_id", "date"])


