"""SQL views of alerts, recommendations and comparisons."""

from headwise.plans.oracle import VIEWS

_S = "CAST({c} AS VARCHAR)"


def alert(kind: str, source: str, severity: str, metric: str, threshold: str, title: str, ident: str, route: str | None = "route_id", stop: str | None = None, where: str = "true", description: str = "NULL") -> str:
    parts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in ident.split(", "))
    subject = f"CAST({route or stop} AS VARCHAR)"
    return f"""SELECT 'alt-' || md5('{kind}|' || {parts}) AS alert_id, '{kind}' AS alert_type, {severity} AS severity, '{title}' || {subject} AS title,
  {f"CAST({route} AS VARCHAR)" if route else "CAST(NULL AS VARCHAR)"} AS affected_route, {f"CAST({stop} AS VARCHAR)" if stop else "CAST(NULL AS VARCHAR)"} AS affected_stop,
  CAST({metric} AS DOUBLE) AS metric_value, '{threshold}' AS threshold_used FROM {source} WHERE {where}"""


VIEWS["latest_critical"] = "SELECT * FROM overcrowding_events WHERE severity = 'critical' QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY date DESC, time_band DESC) = 1"
VIEWS["underused_routes"] = """SELECT route_id, count(*) AS underutil_bands, avg(avg_occupancy_pct) AS avg_occupancy, avg(avg_boardings) AS avg_boardings
FROM underutilization GROUP BY 1 HAVING count(*) >= 2"""
VIEWS["persistent_bunching"] = """SELECT b.*, m.bunching_share, m.on_time_share FROM (SELECT route_id, count(DISTINCT date) AS event_days, CAST(sum(bunched_trips) AS BIGINT) AS total_bunched,
  avg(avg_headway_ratio) AS avg_ratio FROM bunching_events GROUP BY 1 HAVING count(DISTINCT date) >= 5) b JOIN route_metrics m ON b.route_id = m.route_id"""

ALERTS = {
    "D01": alert(
        "severe_delay", "route_metrics", "CASE WHEN avg_delay_min > 20 THEN 'critical' ELSE 'high' END", "avg_delay_min", "RELIABILITY_DEGRADED=0.75",
        "Severe delays on route ", "route_id", where="on_time_share < 0.75e0 OR avg_delay_min > 15 OR severe_critical_share > 0.2e0",
    ),
    "D02": alert(
        "persistent_overcrowding", "persistent_overcrowding", "CASE WHEN critical_days > 30 THEN 'critical' WHEN crowded_days > 20 THEN 'high' ELSE 'critical' END",
        "crowded_days", "PERSISTENT_CROWDING_MIN_DAYS=15", "Persistent overcrowding on route ", "route_id",
    ),
    "D03": alert(
        "critical_crowding_event", "latest_critical", "'critical'", "critical_share*100", "CROWDING_CRITICAL=1.0", "Critical crowding event on route ",
        "route_id, date, time_band", where="route_id NOT IN (SELECT route_id FROM persistent_overcrowding)",
    ),
    "D04": alert(
        "reliability_degraded", "quality_days", "CASE WHEN status = 'critical' THEN 'critical' ELSE 'high' END", "quality_score", "RELIABILITY_DEGRADED=0.75",
        "Reliability degraded on route ", "route_id, date", where="status IN ('degraded', 'critical')",
    ),
    "D05": alert(
        "stop_bottleneck", "stop_metrics", "CASE WHEN bottleneck_score > 90 THEN 'critical' ELSE 'high' END", "bottleneck_score", "BOTTLENECK_PERCENTILE=0.6",
        "Stop bottleneck detected at ", "stop_id", route=None, stop="stop_id", where="is_bottleneck",
    ),
    "D06": alert(
        "demand_anomaly", "anomalies", "CASE WHEN abs(z_score) > 4 THEN 'high' ELSE 'medium' END", "z_score", "ANOMALY_ZSCORE=2.5", "Demand anomaly on route ",
        "route_id, date", where="abs(z_score) > 3",
    ),
    "D07": alert("underutilized_route", "underused_routes", "'medium'", "avg_occupancy", "UNDERUTILIZATION_MAX=0.25", "Underutilized route ", "route_id"),
    "D08": alert("bunching_persistent", "persistent_bunching", "'high'", "bunching_share*100", "bunching_share > 0.15", "Persistent bunching on route ", "route_id"),
}
VIEWS["alerts"] = " UNION ALL ".join(ALERTS.values())


def recommend(category: str, source: str, priority: str, metric: str, threshold: str, confidence: str, title: str, ident: str, route: str | None = "route_id", stop: str | None = None, where: str = "true") -> str:
    parts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in ident.split(", "))
    return f"""SELECT 'rec-' || md5(category || '|' || {parts}) AS recommendation_id, category, priority,
  {f"CAST({route} AS VARCHAR)" if route else "CAST(NULL AS VARCHAR)"} AS affected_route, {f"CAST({stop} AS VARCHAR)" if stop else "CAST(NULL AS VARCHAR)"} AS affected_stop,
  {title} AS title, CAST({metric} AS DOUBLE) AS metric_value, '{threshold}' AS threshold_used, CAST({confidence} AS DOUBLE) AS confidence
FROM (SELECT *, {category} AS category, {priority} AS priority FROM {source}) WHERE {where}"""


def prio(**cols: str) -> str:
    """CASE over the tiers for the metrics that a source has (key -> column)."""
    from headwise.operators.recommendations import LOWER_IS_WORSE, PRIORITY_RULES

    whens = []
    for tier, limits in PRIORITY_RULES.items():
        conds = [f"{cols[k]} {'<=' if k in LOWER_IS_WORSE else '>='} {float(v)}e0" for k, v in limits.items() if k in cols]
        if conds:
            whens.append(f"WHEN {' OR '.join(conds)} THEN '{tier}'")
    return f"CASE {' '.join(whens)} ELSE 'LOW' END"


VIEWS["persistent_metrics"] = """SELECT p.*, m.crowding_share, m.critical_crowding_share, m.occupancy_avg_pct, m.occupancy_max_pct FROM persistent_overcrowding p JOIN route_metrics m ON p.route_id = m.route_id"""
VIEWS["single_critical"] = """SELECT * FROM overcrowding_events WHERE severity = 'critical' AND route_id NOT IN (SELECT route_id FROM persistent_overcrowding) AND route_id IN (SELECT route_id FROM route_metrics)"""
_LATE = prio(on_time_share="on_time_share", severe_critical_share="severe_critical_share")
VIEWS["late_routes"] = f"SELECT * EXCLUDE (category) FROM route_metrics WHERE ({_LATE}) <> 'LOW' OR on_time_share <= 0.8e0"
VIEWS["watch_days"] = "SELECT * FROM quality_days WHERE status IN ('degraded', 'critical') AND route_id NOT IN (SELECT route_id FROM late_routes)"
VIEWS["serving_routes"] = """SELECT stop_id, string_agg(CAST(route_id AS VARCHAR), ', ' ORDER BY route_id) AS routes_serving, min(route_id) AS first_route FROM (
  SELECT DISTINCT stop_id, route_id FROM stop_facts QUALIFY dense_rank() OVER (PARTITION BY stop_id ORDER BY route_id) <= 5) GROUP BY 1"""
VIEWS["bottleneck_served"] = "SELECT m.*, s.routes_serving, s.first_route FROM stop_metrics m LEFT JOIN serving_routes s ON m.stop_id = s.stop_id WHERE m.is_bottleneck"
VIEWS["underused_metrics"] = "SELECT u.*, m.underutilized_share, m.occupancy_avg_pct, m.passengers FROM underused_routes u JOIN route_metrics m ON u.route_id = m.route_id"
VIEWS["anomaly_groups"] = """SELECT route_id, count(*) AS anomaly_count, count(*) FILTER (WHERE anomaly_type = 'high demand') AS high_demand_count,
  count(*) FILTER (WHERE anomaly_type = 'low demand') AS low_demand_count, max(z_score) AS max_zscore FROM anomalies GROUP BY 1 HAVING count(*) >= 3"""
_P1 = prio(crowding_share="crowding_share", critical_crowding_share="critical_crowding_share", persistent_crowding_days="crowded_days")
RECOMMENDATIONS = {
    "R03": recommend(
        "'capacity_increase'", "persistent_metrics", _P1, "crowding_share", "0.85", "CASE WHEN priority IN ('CRITICAL', 'HIGH') THEN 0.9 ELSE 0.75 END",
        "'Capacity increase for ' || route_id", "route_id",
    )
    + " UNION ALL "
    + recommend(
        "'capacity_increase'", "single_critical", prio(crowding_share="crowded_share", critical_crowding_share="critical_share"), "critical_share", "1.0", "0.85",
        "'Critical crowding event on ' || route_id", "route_id, date, time_band",
    ),
    "R04": recommend(
        "'frequency_increase'", "persistent_bunching", prio(bunching_share="bunching_share", on_time_share="on_time_share"), "bunching_share", "bunching_share > 0.15", "0.8",
        "'Frequency increase for ' || route_id", "route_id", where="priority <> 'LOW'",
    ),
    "R05": recommend(
        "CASE WHEN severe_critical_share > 0.2e0 OR avg_delay_min > 15 THEN 'delay_reduction' WHEN adherence_share < 0.6e0 THEN 'schedule_adjustment' ELSE 'delay_reduction' END",
        "late_routes", _LATE, "avg_delay_min", "on_time_share < 0.75", "0.85",
        "CASE category WHEN 'schedule_adjustment' THEN 'Schedule adjustment for ' ELSE 'Delay reduction for ' END || route_id", "route_id",
    )
    + " UNION ALL "
    + recommend(
        "'operational_monitoring'", "watch_days", "CASE WHEN status = 'critical' THEN 'HIGH' ELSE 'MEDIUM' END", "quality_score", "RELIABILITY_DEGRADED=0.75", "0.8",
        "'Reliability monitoring for ' || route_id", "route_id, date",
    ),
    "R06": recommend(
        "'stop_intervention'", "bottleneck_served", prio(bottleneck_score="bottleneck_score", crowding_share="crowding_share"), "bottleneck_score",
        "bottleneck_score > 60th percentile", "0.85", "'Stop intervention at ' || stop_id", "stop_id", route="first_route", stop="stop_id", where="priority <> 'LOW'",
    ),
    "R07": recommend(
        "CASE WHEN passengers < 1000 THEN 'vehicle_reallocation' ELSE 'underutilized_review' END", "underused_metrics", prio(underutilized_share="underutilized_share"),
        "underutilized_share", "UNDERUTILIZATION_MAX=0.25", "0.75", "'Underutilized route review: ' || route_id", "route_id", where="priority <> 'LOW'",
    ),
    "R08": recommend(
        "'demand_based_planning'", "anomaly_groups", prio(demand_anomaly_z="max_zscore"), "max_zscore", "ANOMALY_ZSCORE=2.5", "0.7",
        "'Demand anomaly review for ' || route_id", "route_id", where="priority <> 'LOW'",
    ),
}
VIEWS["recommendations"] = " UNION ALL ".join(RECOMMENDATIONS.values())

VIEWS["route_stop_pairs"] = """SELECT p.*, m.is_bottleneck, m.boardings FROM (SELECT DISTINCT route_id, stop_id FROM stop_facts) p LEFT JOIN stop_metrics m ON p.stop_id = m.stop_id"""
VIEWS["route_detail"] = """
SELECT m.route_id, m.route_score, m.passengers, m.avg_delay_min, m.on_time_share, m.occupancy_avg_pct, coalesce(c.n, 0) AS crowding_events, coalesce(c.d, 0) AS persistent_crowding_days,
  coalesce(b.n, 0) AS bunching_events, q.s AS avg_quality_score, q.st AS reliability_status, coalesce(d.a, 0) AS avg_daily_passengers, CAST(coalesce(d.p, 0) AS DOUBLE) AS peak_daily_passengers,
  coalesce(s.b, 0) AS bottleneck_stops, coalesce(s.n, 0) AS total_stops
FROM route_metrics m LEFT JOIN (SELECT route_id, count(*) AS n, count(DISTINCT date) AS d FROM overcrowding_events GROUP BY 1) c ON m.route_id = c.route_id
LEFT JOIN (SELECT route_id, count(*) AS n FROM bunching_events GROUP BY 1) b ON m.route_id = b.route_id
LEFT JOIN (SELECT route_id, avg(quality_score) AS s, arg_max(status, date) AS st FROM quality_days GROUP BY 1) q ON m.route_id = q.route_id
LEFT JOIN (SELECT route_id, avg(passengers) AS a, max(passengers) AS p FROM daily_demand GROUP BY 1) d ON m.route_id = d.route_id
LEFT JOIN (SELECT route_id, count(*) FILTER (WHERE is_bottleneck) AS b, count(*) AS n FROM route_stop_pairs GROUP BY 1) s ON m.route_id = s.route_id"""
VIEWS["baseline_row"] = """
SELECT CAST(count(*) AS DOUBLE) AS total_routes, avg(avg_delay_min) AS avg_delay_min, avg(occupancy_avg_pct) AS avg_occupancy_avg_pct, avg(occupancy_max_pct) AS avg_occupancy_max_pct,
  avg(on_time_share) AS on_time_share, avg(bunching_share) AS avg_bunching_share, avg(avg_headway_min) AS avg_headway_min, CAST(count(*) FILTER (WHERE underutilized_share > 0.5e0) AS DOUBLE) AS underutilized_routes,
  (SELECT avg(p) FROM (SELECT sum(passengers) AS p FROM daily_demand GROUP BY date)) AS total_passengers_daily, (SELECT avg(r) FROM (SELECT sum(revenue) AS r FROM daily_demand GROUP BY date)) AS avg_revenue_daily,
  CAST((SELECT count(*) FROM overcrowding_events) AS DOUBLE) AS overcrowding_events, CAST((SELECT count(*) FILTER (WHERE is_bottleneck) FROM stop_metrics) AS DOUBLE) AS bottleneck_stops
FROM route_metrics"""
