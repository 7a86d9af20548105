"""Alerts (D), recommendations (R), comparison (K) and the baseline row (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwise.operators import alerts as D
from headwise.operators import compare as K
from headwise.operators import recommendations as R
from headwise.operators import baseline as Q
from headwise.plans.catalog import query
from headwise.plans.frames import DECISION_TABLES, NOW, PROFILE_TABLES, Layer
from headwise.plans.oracle_decisions import ALERTS, RECOMMENDATIONS
from headwise.sources import star

ALERT_COLUMNS = ("alert_id", "alert_type", "severity", "title", "affected_route", "affected_stop", "metric_value", "threshold_used")
REC_COLUMNS = (
    "recommendation_id", "category", "priority", "affected_route", "affected_stop", "title", "metric_value", "threshold_used", "confidence",
)
_SEVERITY_ORDER = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_PRIORITY_ORDER = "CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"


@query("D01_severe_delay_alerts", ALERTS["D01"])
def _(spark, root):
    return D.delay_alerts(Layer(spark, root)["route_metrics"], now=NOW).select(*ALERT_COLUMNS)


@query("D02_persistent_crowding_alerts", ALERTS["D02"])
def _(spark, root):
    return D.persistent_crowding_alerts(Layer(spark, root)["persistent_overcrowding"], now=NOW).select(*ALERT_COLUMNS)


@query("D03_latest_critical_event_alerts", ALERTS["D03"])
def _(spark, root):
    layer = Layer(spark, root)
    return D.critical_event_alerts(layer["overcrowding_events"], layer["persistent_overcrowding"], now=NOW).select(*ALERT_COLUMNS)


@query("D03_latest_critical_per_route", "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM latest_critical")
def _(spark, root):
    return D.latest_critical(Layer(spark, root)["overcrowding_events"])


@query("D04_reliability_day_alerts", ALERTS["D04"])
def _(spark, root):
    return D.reliability_alerts(Layer(spark, root)["quality_days"], now=NOW).select(*ALERT_COLUMNS)


@query("D05_bottleneck_stop_alerts", ALERTS["D05"])
def _(spark, root):
    return D.stop_alerts(Layer(spark, root)["stop_metrics"], now=NOW).select(*ALERT_COLUMNS)


@query("D06_demand_anomaly_alerts", ALERTS["D06"])
def _(spark, root):
    return D.anomaly_alerts(Layer(spark, root)["anomalies"], now=NOW).select(*ALERT_COLUMNS)


@query("D07_underused_route_alerts", ALERTS["D07"])
def _(spark, root):
    return D.underused_alerts(Layer(spark, root)["underutilization"], now=NOW).select(*ALERT_COLUMNS)


@query("D08_persistent_bunching_alerts", ALERTS["D08"])
def _(spark, root):
    layer = Layer(spark, root)
    return D.bunching_alerts(layer["bunching_events"], layer["route_metrics"], now=NOW).select(*ALERT_COLUMNS)


@query(
    "D09_severity_escalation",
    """SELECT trip_id, CASE WHEN departure_delay_min > 20 THEN 'critical' ELSE 'high' END AS severity,
    CASE WHEN occupancy_max_pct > 90 THEN 'critical' ELSE 'high' END AS stop_severity FROM trips_core""",
)
def _(spark, root):
    delay = F.create_map(F.lit("avg_delay_min"), F.col("departure_delay_min"))
    load = F.create_map(F.lit("score"), F.col("occupancy_max_pct"))
    return star.trips_core(spark, root).select(
        "trip_id",
        D.alert_severity(F.lit("severe_delay"), delay).alias("severity"),
        D.alert_severity(F.lit("stop_bottleneck"), load).alias("stop_severity"),
    )


@query("D10_all_alerts", f"SELECT *, {_SEVERITY_ORDER} AS severity_rank FROM alerts")
def _(spark, root):
    alerts = D.in_severity_order(Layer(spark, root)["alerts"])
    return alerts.select(*ALERT_COLUMNS, D.severity_rank().alias("severity_rank"))


@query("D10_alert_counts", "SELECT alert_type, severity, count(*) AS count FROM alerts GROUP BY 1, 2")
def _(spark, root):
    return Layer(spark, root)["alerts"].groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("count"))


@query(
    "D11_alert_status_update",
    f"""SELECT alert_id, CASE WHEN severity = 'critical' THEN 'acknowledged' ELSE 'new' END AS status, CASE WHEN severity = 'critical' THEN '{NOW}' END AS acknowledged_at FROM alerts""",
)
def _(spark, root):
    alerts = Layer(spark, root)["alerts"]
    out = D.update_status(alerts, alerts.where("severity = 'critical'").select("alert_id"), "acknowledged", NOW)
    return out.select("alert_id", "status", "acknowledged_at")


# Recommendations --------------------------------------------------------------------------------------------------


@query(
    "R01_priority_tiers",
    """SELECT route_id, date, time_band, CASE WHEN crowded_share >= 0.4e0 OR critical_share >= 0.1e0 THEN 'CRITICAL' WHEN crowded_share >= 0.25e0 OR critical_share >= 0.05e0 THEN 'HIGH'
    WHEN crowded_share >= 0.15e0 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM (SELECT route_id, CAST(date AS VARCHAR) AS date, time_band,
    count(*) FILTER (WHERE occupancy_max_pct >= 85)/count(*) AS crowded_share, count(*) FILTER (WHERE occupancy_max_pct >= 100)/count(*) AS critical_share FROM trips_core GROUP BY 1, 2, 3)""",
)
def _(spark, root):
    from headwise.functions import scalars as X

    cells = star.trips_core(spark, root).groupBy("route_id", "date", "time_band").agg(
        X.share(F.col("occupancy_max_pct") >= 85).alias("c"), X.share(F.col("occupancy_max_pct") >= 100).alias("k")
    )
    evidence = F.create_map(F.lit("crowding_share"), F.col("c"), F.lit("critical_crowding_share"), F.col("k"))
    return cells.select("route_id", "date", "time_band", R.priority_of(evidence).alias("priority"))


@query(
    "R02_category_actions",
    "SELECT r.recommendation_id, a.action AS suggested_action FROM recommendations r JOIN (VALUES "
    + ", ".join(f"('{c}', '{a}')" for c, (a, _) in R.CATEGORY_ACTIONS.items())
    + ") a(category, action) ON r.category = a.category",
)
def _(spark, root):
    layer = Layer(spark, root, *DECISION_TABLES)
    return R.build_recommendations(layer, layer["stop_facts"], now=NOW).select("recommendation_id", "suggested_action")


@query("R03_capacity_recommendations", RECOMMENDATIONS["R03"])
def _(spark, root):
    layer = Layer(spark, root)
    out = R.capacity_recommendations(layer["persistent_overcrowding"], layer["overcrowding_events"], layer["route_metrics"], now=NOW)
    return out.select(*REC_COLUMNS)


@query("R04_frequency_recommendations", RECOMMENDATIONS["R04"])
def _(spark, root):
    layer = Layer(spark, root)
    return R.frequency_recommendations(layer["bunching_events"], layer["route_metrics"], now=NOW).select(*REC_COLUMNS)


@query("R05_delay_recommendations", RECOMMENDATIONS["R05"])
def _(spark, root):
    layer = Layer(spark, root)
    return R.delay_recommendations(layer["route_metrics"], layer["quality_days"], now=NOW).select(*REC_COLUMNS)


@query("R06_stop_recommendations", RECOMMENDATIONS["R06"])
def _(spark, root):
    layer = Layer(spark, root)
    return R.stop_recommendations(layer["stop_metrics"], layer["stop_facts"], now=NOW).select(*REC_COLUMNS)


@query("R06_routes_serving_stop", "SELECT stop_id, routes_serving FROM serving_routes")
def _(spark, root):
    out = R.serving_routes(star.stop_facts(spark, root))
    return out.select("stop_id", F.array_join("routes_serving", ", ").alias("routes_serving"))


@query("R07_underused_recommendations", RECOMMENDATIONS["R07"])
def _(spark, root):
    layer = Layer(spark, root)
    return R.underused_recommendations(layer["underutilization"], layer["route_metrics"], now=NOW).select(*REC_COLUMNS)


@query("R08_demand_planning", RECOMMENDATIONS["R08"])
def _(spark, root):
    return R.demand_recommendations(Layer(spark, root)["anomalies"], now=NOW).select(*REC_COLUMNS)


@query("R09_all_recommendations", f"SELECT *, {_PRIORITY_ORDER} AS priority_rank FROM recommendations")
def _(spark, root):
    layer = Layer(spark, root, *DECISION_TABLES)
    recs = R.in_priority_order(R.build_recommendations(layer, layer["stop_facts"], now=NOW))
    return recs.select(*REC_COLUMNS, R.priority_rank().alias("priority_rank"))


@query("R09_recommendation_counts", "SELECT priority, category, count(*) AS count FROM recommendations GROUP BY 1, 2")
def _(spark, root):
    layer = Layer(spark, root, *DECISION_TABLES)
    recs = R.build_recommendations(layer, layer["stop_facts"], now=NOW)
    return recs.groupBy("priority", "category").agg(F.count(F.lit(1)).alias("count"))


@query("R10_explanations")
def _(spark, root):
    layer = Layer(spark, root, *DECISION_TABLES)
    recs = R.with_explanation(R.build_recommendations(layer, layer["stop_facts"], now=NOW))
    return recs.select("recommendation_id", "explanation")


# Comparison -------------------------------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(
    f"SELECT route_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM route_metrics WHERE route_id IN (SELECT route_id FROM persistent_overcrowding)"
    for g in ("demand", "delay") for m in K.METRIC_GROUPS[g]
)


def _long(spark, root):
    layer = Layer(spark, root)
    return K.compare(layer["route_metrics"], layer["persistent_overcrowding"].select("route_id"), ["Demand", "delay"])


@query("K01_side_by_side_metrics", _LONG)
def _(spark, root):
    return _long(spark, root)


@query(
    "K02_difference_from_median",
    f"""SELECT *, value - median AS difference FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY metric) AS median, count(*) OVER (PARTITION BY metric) AS n FROM ({_LONG}))
    WHERE n >= 2""".replace("SELECT *, value", "SELECT route_id, metric, value, median, value", 1),
)
def _(spark, root):
    return K.median_differences(_long(spark, root))


@query("K03_detailed_comparison", "SELECT * FROM route_detail")
def _(spark, root):
    return K.detailed(Layer(spark, root, *PROFILE_TABLES))


@query(
    "K04_comparison_summary",
    """SELECT count(*) AS routes_compared, avg(route_score) AS avg_route_score, CAST(sum(passengers) AS BIGINT) AS total_passengers, avg(avg_delay_min) AS avg_delay_min, avg(on_time_share)*100 AS avg_on_time_pct,
    avg(occupancy_avg_pct) AS avg_occupancy_pct, CAST(sum(crowding_events) AS BIGINT) AS total_crowding_events, CAST(sum(bunching_events) AS BIGINT) AS total_bunching_events FROM route_detail""",
)
def _(spark, root):
    return K.comparison_summary(K.detailed(Layer(spark, root, *PROFILE_TABLES)))


@query("K05_top_and_bottom_routes", "SELECT 'top' AS side, * FROM (SELECT route_id, avg_delay_min FROM route_metrics ORDER BY avg_delay_min DESC, route_id LIMIT 10) UNION ALL SELECT 'bottom', * FROM (SELECT route_id, avg_delay_min FROM route_metrics ORDER BY avg_delay_min, route_id LIMIT 10)")
def _(spark, root):
    m = Layer(spark, root)["route_metrics"].select("route_id", "avg_delay_min")
    top = K.rank(m, "avg_delay_min").select(F.lit("top").alias("side"), "*")
    return top.unionByName(K.rank(m, "avg_delay_min", ascending=True).select(F.lit("bottom").alias("side"), "*"))


@query(
    "K06_route_profiles",
    """SELECT d.*, t.top_boarding_stops, c.critical_events, c.high_events, c.peak_bands, b.bunching_days, q.degraded_days, q.critical_days, w.trend_7d FROM route_detail d
    LEFT JOIN (SELECT route_id, string_agg(CAST(stop_id AS VARCHAR), ', ' ORDER BY rn) AS top_boarding_stops FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY boardings DESC NULLS LAST, stop_id) AS rn FROM route_stop_pairs) WHERE rn <= 5 GROUP BY 1) t ON d.route_id = t.route_id
    LEFT JOIN (SELECT route_id, count(*) FILTER (WHERE severity = 'critical') AS critical_events, count(*) FILTER (WHERE severity = 'high') AS high_events, string_agg(DISTINCT time_band, ', ' ORDER BY time_band) AS peak_bands FROM overcrowding_events GROUP BY 1) c ON d.route_id = c.route_id
    LEFT JOIN (SELECT route_id, count(DISTINCT date) AS bunching_days FROM bunching_events GROUP BY 1) b ON d.route_id = b.route_id
    LEFT JOIN (SELECT route_id, count(*) FILTER (WHERE status = 'degraded') AS degraded_days, count(*) FILTER (WHERE status = 'critical') AS critical_days FROM quality_days GROUP BY 1) q ON d.route_id = q.route_id
    LEFT JOIN (SELECT route_id, CASE WHEN count(*) = 7 THEN avg(passengers) END AS trend_7d FROM (SELECT * FROM daily_demand QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY date DESC) <= 7) GROUP BY 1) w ON d.route_id = w.route_id""",
)
def _(spark, root):
    return K.profiles(Layer(spark, root, *PROFILE_TABLES))


@query(
    "K07_executive_kpis",
    """SELECT count(*) AS total_routes, avg(avg_delay_min) AS avg_delay_min, avg(occupancy_avg_pct) AS avg_occupancy_pct, avg(on_time_share)*100 AS on_time_pct,
    count(*) FILTER (WHERE underutilized_share > 0.5e0) AS underutilized_routes, avg(route_score) AS route_score_avg, (SELECT count(DISTINCT stop_id) FROM stop_metrics) AS active_stops,
    (SELECT avg(p) FROM (SELECT sum(passengers) AS p FROM daily_demand GROUP BY date)) AS total_passengers_daily, (SELECT count(*) FROM overcrowding_events) AS overcrowding_events,
    (SELECT count(*) FROM persistent_overcrowding) AS persistent_overcrowding_routes, (SELECT count(*) FROM alerts) AS active_alerts, (SELECT count(*) FROM alerts WHERE severity = 'critical') AS critical_alerts,
    (SELECT count(*) FROM stop_metrics WHERE is_bottleneck) AS bottleneck_stops FROM route_metrics""",
)
def _(spark, root):
    return K.kpis(Layer(spark, root, "alerts", "daily_demand"))


@query(
    "K08_filters",
    "SELECT route_id, CAST(date AS VARCHAR) AS date, time_band, severity FROM overcrowding_events WHERE severity IN ('high') AND date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'",
)
def _(spark, root):
    df = Layer(spark, root)["overcrowding_events"].select("route_id", "date", "time_band", "severity")
    df = K.filter_in(K.filter_in(df, "severity", ["high"]), "priority", ["LOW"])
    return K.filter_dates(K.filter_in(df, "route_id", []), "date", "2024-01-08", "2024-01-21")


@query(
    "K10_score_category_class_filter",
    "SELECT route_id, route_score, category, route_class FROM route_metrics WHERE route_score BETWEEN 20 AND 75 AND category IN ('core', 'express') AND route_class IN ('Solid', 'Needs Attention', 'Action Required')",
)
def _(spark, root):
    m = Layer(spark, root)["route_metrics"].select("route_id", "route_score", "category", "route_class")
    return K.filter_scores(m, 20, 75, ["core", "express"], ["Solid", "Needs Attention", "Action Required"])


BASELINE_TABLES = ("stop_metrics", "route_metrics", "daily_demand", "overcrowding_events", "persistent_overcrowding")

# Baseline ---------------------------------------------------------------------------------------------------------


@query("Q01_baseline_row", "SELECT * FROM baseline_row")
def _(spark, root):
    return Q.baseline(Layer(spark, root, *BASELINE_TABLES))
