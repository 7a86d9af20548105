"""Rule-driven alerts over the analytics tables, as filtered projections to one schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X

T = S.DEFAULTS

# Default severity per alert type, then escalations (evidence key, limit exceeded, severity) in order.
SEVERITY_RULES = {
    "severe_delay": ("high", (("avg_delay_min", 20.0, "critical"), ("severe_pct", 30.0, "high"))),
    "persistent_overcrowding": ("critical", (("critical_days", 30.0, "critical"), ("crowded_days", 20.0, "high"))),
    "critical_crowding_event": ("critical", (("critical_share_pct", 50.0, "critical"),)),
    "reliability_degraded": ("high", (("status_critical", 0.0, "critical"),)),
    "stop_bottleneck": ("high", (("score", 90.0, "critical"),)),
    "demand_anomaly": ("medium", (("abs_z_score", 4.0, "high"),)),
    "underutilized_route": ("medium", ()),
    "bunching_persistent": ("high", ()),
}
STATUSES = ("new", "acknowledged", "resolved")
# Alert titles and descriptions (printf slots).
TEXTS = {
    "severe_delay": (
        "Severe delays on route %s",
        "Route %s has average delay %.1f min (on-time %.1f%%, severe/critical %.1f%%).",
    ),
    "persistent_overcrowding": (
        "Persistent overcrowding on route %s",
        "Route %s has been overcrowded on %d days (%d critical). Peak bands: %s.",
    ),
    "critical_crowding_event": (
        "Critical crowding event on route %s",
        "Route %s on %s (%s) had critical crowding: %.1f%% trips critically crowded, avg occupancy %.1f%%.",
    ),
    "reliability_degraded": (
        "Reliability degraded on route %s",
        "Route %s on %s has %s reliability: on-time %.1f%%, quality score %.1f.",
    ),
    "stop_bottleneck": (
        "Stop bottleneck detected at %s",
        "Stop %s (%s) is a bottleneck (score %.1f). Avg arrival delay %.1f min, crowding share %.1f%%.",
    ),
    "demand_anomaly": (
        "Demand anomaly on route %s",
        "Route %s on %s has %s (z-score %.2f, %d passengers).",
    ),
    "underutilized_route": (
        "Underutilized route %s",
        "Route %s has %d time bands with ≥50%% trips underutilized. Avg occupancy %.1f%%, avg boardings %.1f.",
    ),
    "bunching_persistent": (
        "Persistent bunching on route %s",
        "Route %s has bunching on %d days. Bunching share %.1f%%, avg headway ratio %.2f.",
    ),
}


def alert_severity(alert_type: Column, evidence: Column) -> Column:
    """Severity by type, escalated by the first exceeded evidence limit; a missing metric never escalates."""
    out = F.when(F.lit(False), F.lit("medium"))
    for kind, (default, rules) in SEVERITY_RULES.items():
        for key, limit, level in rules:
            out = out.when((alert_type == kind) & (F.try_element_at(evidence, F.lit(key)) > limit), level)
        out = out.when(alert_type == kind, default)
    return out.otherwise("medium")


def _alerts(
    df: DataFrame, kind: str, evidence: Mapping[str, Column], metric: Column, threshold: str, texts: Sequence[Column],
    identity: Sequence[str], route: str | None = "route_id", stop: str | None = None, now: str | None = None,
) -> DataFrame:
    subject = F.col(route or stop).cast("string")
    title, description = TEXTS[kind]
    pairs = [c for k, v in evidence.items() for c in (F.lit(k), v.cast("double"))]
    stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    ident = F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in identity])
    none = F.lit(None).cast("string")
    return df.select(
        F.concat(F.lit("alt-"), F.md5(ident)).alias("alert_id"),
        F.lit(kind).alias("alert_type"),
        F.format_string(title, subject).alias("title"),
        F.format_string(description, subject, *texts).alias("description"),
        (F.col(route).cast("string") if route else none).alias("affected_route"),
        (F.col(stop).cast("string") if stop else none).alias("affected_stop"),
        F.create_map(*pairs).alias("evidence"),
        metric.cast("double").alias("metric_value"),
        F.lit(threshold).alias("threshold_used"),
        stamp.alias("timestamp"),
        F.lit("new").alias("status"),
        none.alias("acknowledged_at"),
        none.alias("resolved_at"),
    ).withColumn("severity", alert_severity(F.col("alert_type"), F.col("evidence")))


def _pct(c: str) -> Column:
    return F.col(c) * X.dbl(100.0)


def delay_alerts(routes: DataFrame, t: S.Thresholds = T, now: str | None = None) -> DataFrame:
    hit = (F.col("on_time_share") < t.reliability_degraded) | (F.col("avg_delay_min") > 15) | (F.col("severe_critical_share") > 0.2)
    return _alerts(
        routes.where(hit), "severe_delay",
        {
            "on_time_share": F.col("on_time_share"), "avg_delay_min": F.col("avg_delay_min"),
            "severe_pct": _pct("severe_critical_share"), "p90_delay_min": F.col("p90_delay_min"),
            "adherence_share": F.col("adherence_share"),
        },
        F.col("avg_delay_min"), f"RELIABILITY_DEGRADED={t.reliability_degraded}",
        [F.col("avg_delay_min"), _pct("on_time_share"), _pct("severe_critical_share")], ["route_id"], now=now,
    )


def persistent_crowding_alerts(persistent: DataFrame, t: S.Thresholds = T, now: str | None = None) -> DataFrame:
    return _alerts(
        persistent, "persistent_overcrowding",
        {c: F.col(c) for c in ("crowded_days", "critical_days", "all_crowded_trips")},
        F.col("crowded_days"), f"PERSISTENT_CROWDING_MIN_DAYS={t.persistent_crowding_min_days}",
        [F.col("crowded_days"), F.col("critical_days"), F.col("peak_crowding_bands")], ["route_id"], now=now,
    )


def latest_critical(crowding: DataFrame) -> DataFrame:
    """The most recent critical crowding cell of each route (later band name on one day)."""
    cols = [c for c in crowding.columns if c != "route_id"]
    last = crowding.where("severity = 'critical'").groupBy("route_id").agg(
        F.max_by(F.struct(*cols), F.struct("date", "time_band")).alias("_e")
    )
    return last.select("route_id", "_e.*")


def critical_event_alerts(crowding: DataFrame, persistent: DataFrame, t: S.Thresholds = T, now: str | None = None) -> DataFrame:
    """Latest critical event per route, unless the route is already persistently crowded."""
    df = latest_critical(crowding).join(persistent.select("route_id"), "route_id", "left_anti")
    return _alerts(
        df, "critical_crowding_event",
        {
            "critical_share_pct": _pct("critical_share"), "crowded_share_pct": _pct("crowded_share"),
            "occupancy": F.col("avg_occupancy_max_pct"),
        },
        _pct("critical_share"), f"CROWDING_CRITICAL={t.crowding_critical}",
        [F.col("date").cast("string"), F.col("time_band"), _pct("critical_share"), F.col("avg_occupancy_max_pct")],
        ["route_id", "date", "time_band"], now=now,
    )


def reliability_alerts(quality: DataFrame, t: S.Thresholds = T, now: str | None = None) -> DataFrame:
    df = quality.where(F.col("status").isin("degraded", "critical"))
    return _alerts(
        df, "reliability_degraded",
        {
            "on_time_share": F.col("on_time_share"), "avg_delay_min": F.col("avg_delay_min"),
            "quality_score": F.col("quality_score"), "status_critical": (F.col("status") == "critical").cast("int"),
        },
        F.col("quality_score"), f"RELIABILITY_DEGRADED={t.reliability_degraded}",
        [F.col("date").cast("string"), F.col("status"), _pct("on_time_share"), F.col("quality_score")],
        ["route_id", "date"], now=now,
    )


def stop_alerts(stops: DataFrame, t: S.Thresholds = T, now: str | None = None) -> DataFrame:
    return _alerts(
        stops.where("is_bottleneck"), "stop_bottleneck",
        {
            "score": F.col("bottleneck_score"), "avg_arr_delay_min": F.col("avg_arr_delay_min"),
            "p95_arr_delay_min": F.col("p95_arr_delay_min"), "crowding_share": F.col("crowding_share"),
            "boardings": F.col("boardings"),
        },
        F.col("bottleneck_score"), f"BOTTLENECK_PERCENTILE={t.bottleneck_percentile}",
        [F.col("stop_name"), F.col("bottleneck_score"), F.col("avg_arr_delay_min"), _pct("crowding_share")],
        ["stop_id"], route=None, stop="stop_id", now=now,
    )


def anomaly_alerts(anomalies: DataFrame, t: S.Thresholds = T, z: float = 3.0, now: str | None = None) -> DataFrame:
    return _alerts(
        anomalies.where(F.abs("z_score") > z), "demand_anomaly",
        {"z_score": F.col("z_score"), "abs_z_score": F.abs("z_score"), "passengers": F.col("passengers")},
        F.col("z_score"), f"ANOMALY_ZSCORE={t.anomaly_zscore}",
        [F.col("date").cast("string"), F.col("anomaly_type"), F.col("z_score"), F.col("passengers")],
        ["route_id", "date"], now=now,
    )


def underused_routes(underused: DataFrame, min_bands: int = 2) -> DataFrame:
    return underused.groupBy("route_id").agg(
        F.count("time_band").alias("underutil_bands"),
        F.avg("avg_occupancy_pct").alias("avg_occupancy"),
        F.avg("avg_boardings").alias("avg_boardings"),
    ).where(F.col("underutil_bands") >= min_bands)


def underused_alerts(underused: DataFrame, t: S.Thresholds = T, now: str | None = None) -> DataFrame:
    return _alerts(
        underused_routes(underused), "underutilized_route",
        {"underutil_bands": F.col("underutil_bands"), "avg_occ": F.col("avg_occupancy"), "avg_boardings": F.col("avg_boardings")},
        F.col("avg_occupancy"), f"UNDERUTILIZATION_MAX={t.underutilization_max}",
        [F.col("underutil_bands"), F.col("avg_occupancy"), F.col("avg_boardings")], ["route_id"], now=now,
    )


def persistent_bunching(bunching: DataFrame, min_days: int = 5) -> DataFrame:
    return bunching.groupBy("route_id").agg(
        F.count_distinct("date").alias("event_days"),
        F.sum("bunched_trips").alias("total_bunched"),
        F.avg("avg_headway_ratio").alias("avg_ratio"),
    ).where(F.col("event_days") >= min_days)


def bunching_alerts(bunching: DataFrame, routes: DataFrame, now: str | None = None) -> DataFrame:
    df = persistent_bunching(bunching).join(routes.select("route_id", "bunching_share"), "route_id")
    return _alerts(
        df, "bunching_persistent",
        {
            "event_days": F.col("event_days"), "total_bunched": F.col("total_bunched"),
            "headway_ratio": F.col("avg_ratio"), "bunching_share_pct": _pct("bunching_share"),
        },
        _pct("bunching_share"), "bunching_share > 0.15",
        [F.col("event_days"), _pct("bunching_share"), F.col("avg_ratio")], ["route_id"], now=now,
    )


def severity_rank(c: Column | str = "severity") -> Column:
    return X.code_of(c, S.SEVERITY_RANK, 4)


def build_alerts(layer: Mapping[str, DataFrame], t: S.Thresholds = T, now: str | None = None) -> DataFrame:
    """All alerts in one frame. ``layer`` holds the persisted analytics tables."""
    parts = [
        delay_alerts(layer["route_metrics"], t, now),
        persistent_crowding_alerts(layer["persistent_overcrowding"], t, now),
        critical_event_alerts(layer["overcrowding_events"], layer["persistent_overcrowding"], t, now),
        reliability_alerts(layer["quality_days"], t, now),
        stop_alerts(layer["stop_metrics"], t, now),
        anomaly_alerts(layer["anomalies"], t, now=now),
        underused_alerts(layer["underutilization"], t, now),
        bunching_alerts(layer["bunching_events"], layer["route_metrics"], now),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_severity_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(severity_rank(), "timestamp", "alert_id")


def update_status(alerts: DataFrame, ids: DataFrame, status: str, now: str) -> DataFrame:
    """Lifecycle transition of the listed alerts; ``_updated`` marks the rows that changed."""
    if status not in STATUSES:
        raise ValueError(f"Invalid status {status!r}; expected one of {', '.join(STATUSES)}")
    listed = ids.select("alert_id").distinct().withColumn("_hit", F.lit(True))
    out = alerts.join(listed, "alert_id", "left").withColumn("_updated", F.coalesce("_hit", F.lit(False)))
    cols = {"status": F.when(F.col("_updated"), F.lit(status)).otherwise(F.col("status"))}
    stamp = {"acknowledged": "acknowledged_at", "resolved": "resolved_at"}.get(status)
    if stamp:
        cols[stamp] = F.when(F.col("_updated"), F.lit(now)).otherwise(F.col(stamp))
    return out.withColumns(cols).drop("_hit")


def save_status(alerts: DataFrame, ids: DataFrame, status: str, now: str, path: str) -> int:
    """Write the transition as a new version of the alert table; returns how many alerts changed."""
    out = update_status(alerts, ids, status, now)
    n = out.agg(X.count_if(F.col("_updated"))).first()[0] or 0
    if n:
        out.drop("_updated").write.mode("error").parquet(path)
    return int(n)
