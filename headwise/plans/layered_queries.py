"""As-of joins, equi-depth scans, levels from one scan, whole folders and runs, and rules whose thresholds select rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions.asof import last_match
from headwise.functions.scans import CHUNK, equi_depth
from headwise.operators import aggregates as A
from headwise.operators import alerts as D
from headwise.operators import features as Fe
from headwise.operators import recommendations as R
from headwise.plans import frames, run
from headwise.plans.catalog import query
from headwise.plans.decision_queries import ALERT_COLUMNS, REC_COLUMNS
from headwise.plans.feature_queries import DELAY, ORDER, prior
from headwise.plans.frames import NOW, Layer
from headwise.plans.oracle import VIEWS
from headwise.plans.oracle_decisions import ALERTS, RECOMMENDATIONS
from headwise.session import shared_folder
from headwise.sources import contracts, star, store

DAY_US = 86_400_000_000


@query(
    "J09_asof_previous_holiday",
    """SELECT t.trip_id, CAST(h.date AS VARCHAR) AS holiday FROM trips_core t ASOF LEFT JOIN (SELECT date FROM trip_calendar WHERE is_holiday) h ON t.date > h.date""",
)
def _(spark, root):
    holidays = star.trip_calendar(spark, root).where("is_holiday").select(F.col("date").alias("holiday"))
    return last_match(star.trips_core(spark, root).select("trip_id", "date"), holidays, [], "date", "holiday", {"holiday": "holiday"}, strict=True).drop("date")


@query(
    "J08_asof_previous_trip_of_vehicle",
    f"""SELECT t.trip_id, CASE WHEN t.us - p.us <= {DAY_US} THEN p.us END AS previous_us, CASE WHEN t.us - p.us <= {DAY_US} THEN p.delay END AS previous_delay
    FROM trips_core t ASOF LEFT JOIN (SELECT vehicle_id, us, max({DELAY}) AS delay FROM trips_core GROUP BY 1, 2) p ON t.vehicle_id = p.vehicle_id AND t.us > p.us""",
)
def _(spark, root):
    trips = star.trips_core(spark, root)
    values = {"previous_us": F.col("us"), "previous_delay": F.col(DELAY)}
    return last_match(trips.select("trip_id", "vehicle_id", "us"), trips, ["vehicle_id"], "us", "us", values, strict=True, tolerance=DAY_US).drop("vehicle_id", "us")


@query("F13_prior_stats_equi_depth", f"SELECT trip_id, {prior('date', 'network_prior_delay')} FROM trips_core")
def _(spark, root):
    trips = equi_depth(star.trips_core(spark, root).select("trip_id", "date", "us", DELAY), ["date", *ORDER])
    out = Fe.prior_stats(trips, ["date"], DELAY, "network_prior_delay", ORDER, F.col(CHUNK))
    return out.select("trip_id", "network_prior_delay_mean", "network_prior_delay_std", "network_prior_delay_count")


_LEVELS = {
    "route_zone": ("route_id", "boarding_zone", "alighting_zone"),
    "route_band_zone": ("route_id", "time_band", "boarding_zone", "alighting_zone"),
    "zone": ("boarding_zone", "alighting_zone"),
}


@query(
    "A20_od_levels",
    """SELECT CASE WHEN GROUPING(route_id) = 1 THEN 'zone' WHEN GROUPING(time_band) = 1 THEN 'route_zone' ELSE 'route_band_zone' END AS level,
    route_id, time_band, boarding_zone, alighting_zone, count(*) AS passengers FROM rides
    GROUP BY GROUPING SETS ((route_id, boarding_zone, alighting_zone), (route_id, time_band, boarding_zone, alighting_zone), (boarding_zone, alighting_zone))""",
)
def _(spark, root):
    return A.od_levels(star.rides(spark, root), _LEVELS).select("level", "route_id", "time_band", "boarding_zone", "alighting_zone", "passengers")


# The same rules with thresholds that select rows of the given tables.
WIDE = replace(S.DEFAULTS, underutilization_max=0.65, persistent_crowding_min_days=40)
VIEWS["underutilization_wide"] = VIEWS["underutilization"].replace("<= 25)", "<= 65)")
VIEWS["underused_routes_wide"] = VIEWS["underused_routes"].replace("underutilization", "underutilization_wide")
VIEWS["underused_metrics_wide"] = VIEWS["underused_metrics"].replace("underused_routes", "underused_routes_wide")
VIEWS["persistent_overcrowding_wide"] = VIEWS["persistent_overcrowding"].replace(">= 15", ">= 40")


def _underused(spark, root):
    return A.underutilization(star.trips_core(spark, root), WIDE)


@query("A24_underutilization_wide", "SELECT * FROM underutilization_wide")
def _(spark, root):
    return _underused(spark, root)


@query("D03_latest_critical_event_alerts_wide", ALERTS["D03"].replace("persistent_overcrowding", "persistent_overcrowding_wide"))
def _(spark, root):
    events = Layer(spark, root)["overcrowding_events"]
    return D.critical_event_alerts(events, A.persistent_overcrowding(events, WIDE), WIDE, now=NOW).select(*ALERT_COLUMNS)


@query("D07_underused_route_alerts_wide", ALERTS["D07"].replace("underused_routes", "underused_routes_wide").replace("MAX=0.25", "MAX=0.65"))
def _(spark, root):
    return D.underused_alerts(_underused(spark, root), WIDE, now=NOW).select(*ALERT_COLUMNS)


@query("R07_underused_recommendations_wide", RECOMMENDATIONS["R07"].replace("underused_metrics", "underused_metrics_wide").replace("MAX=0.25", "MAX=0.65"))
def _(spark, root):
    return R.underused_recommendations(_underused(spark, root), Layer(spark, root)["route_metrics"], WIDE, now=NOW).select(*REC_COLUMNS)


@query("S08_tag_and_save_wide", "SELECT route_id, time_band, trips_total, underused_share, '1.0' AS analytics_version FROM underutilization_wide")
def _(spark, root):
    saved = store.save(_underused(spark, root), f"{shared_folder(spark)}/tagged-{frames.unique()}", "underutilization")
    return saved.select("route_id", "time_band", "trips_total", "underused_share", "analytics_version")


@query(
    "V20_validate_folder",
    """SELECT 'routes' AS dataset, 'Primary key route_id is not unique: ' || count(*) * 2 || ' rows share a key' AS message FROM routes WHERE route_id % 5 = 0
    UNION ALL SELECT 'routes', 'length_km: ' || count(*) || ' values above 80' FROM routes WHERE route_id % 5 = 0
    UNION ALL SELECT 'vehicles', 'Primary key vehicle_id is not unique: ' || count(*) * 3 || ' rows share a key' FROM vehicles WHERE capacity > 100
    UNION ALL SELECT 'calendar', 'Failed to load' UNION ALL SELECT 'stops', 'Missing dataset: stops'""",
)
def _(spark, root):
    """A folder with a parquet and a csv data set that break their keys, an unreadable one, and missing ones."""
    folder = f"{shared_folder(spark)}/contracts-{frames.unique()}"
    routes = star.routes(spark, root).withColumn("route_id", F.col("route_id").cast("string")).drop("stops_count")
    again = routes.where("cast(route_id as bigint) % 5 = 0").withColumn("length_km", F.lit(100.0))
    routes.unionByName(again).write.parquet(f"{folder}/routes.parquet")
    vehicles = star.vehicles(spark, root)
    twice = vehicles.where("capacity > 100")
    vehicles.unionByName(twice).unionByName(twice).write.csv(f"{folder}/vehicles.csv", header=True)
    spark.range(1).selectExpr("'no parquet' AS value").write.text(f"{folder}/calendar.parquet")
    found = contracts.validate_folder(spark, folder)
    rows = [(name, e) for name in ("routes", "vehicles", "calendar", "stops") for e in found[name].errors if not e.startswith("Invalid category")]
    out = spark.createDataFrame(rows, "dataset string, message string")
    loaded = F.when(F.col("message").startswith("Failed to load"), "Failed to load").otherwise(F.col("message"))
    return out.select("dataset", loaded.alias("message"))


@query(
    "V21_contracted_columns",
    """SELECT 'routes' AS dataset, 'length_km' AS "column", 'numeric' AS type, false AS in_key, 0.5e0 AS lower, 80e0 AS upper, count(length_km) AS filled,
    count(*) FILTER (WHERE length_km < 0.5 OR length_km > 80) AS outside FROM routes UNION ALL
    SELECT 'vehicles', 'capacity', 'integer', false, 1e0, 400e0, count(capacity), count(*) FILTER (WHERE capacity < 1 OR capacity > 400) FROM raw_vehicles""",
)
def _(spark, root):
    """Bounded columns of the contract table, with what two delivered data sets hold in them."""
    bounded = contracts.contract_table(spark).where("lower IS NOT NULL").select("dataset", "column", "type", "in_key", "lower", "upper")
    held = None
    for name, df, column in (("routes", star.routes(spark, root), "length_km"), ("vehicles", star.raw_vehicles(spark, root), "capacity")):
        one = df.select(F.lit(name).alias("dataset"), F.lit(column).alias("column"), F.col(column).cast("double").alias("v"))
        held = one if held is None else held.unionByName(one)
    outside = F.sum(((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).cast("long"))
    return held.join(bounded, ["dataset", "column"]).groupBy("dataset", "column", "type", "in_key", "lower", "upper").agg(F.count("v").alias("filled"), F.coalesce(outside, F.lit(0)).alias("outside"))


@query(
    "A38_analytics_run",
    " UNION ALL ".join(
        f"SELECT 'analytics:{v}' AS action, 'analytics' AS component, 'ok' AS status, 'rows=' || count(*) AS details FROM {v}"
        for v in ("overcrowding_events", "persistent_overcrowding", "quality_days", "bunching_events")
    )
    + " UNION ALL SELECT 'analytics:broken', 'analytics', 'failed', 'ValueError: no such step' UNION ALL SELECT 'analytics:route_metrics', 'analytics', 'skipped', ''",
)
def _(spark, root):
    """A run with a step that fails and one that is left out; the others are built and saved."""
    layer = Layer(spark, root)

    def broken():
        raise ValueError("no such step")

    steps = {"broken": broken} | {n: (lambda n=n: layer[n]) for n in ("overcrowding_events", "persistent_overcrowding", "quality_days", "bunching_events", "route_metrics")}
    base = f"{shared_folder(spark)}/run-{frames.unique()}"
    log = run.run_steps(spark, steps, lambda name, df: store.save(df, base, name), skip=("route_metrics",))
    return log.select("action", "component", "status", "details")


_GUARDED = {
    **dict.fromkeys(("scheduled_travel_min", "distance_km", "direction", "capacity", "hour"), "A"),
    **dict.fromkeys(("departure_delay_min", "on_time", "boardings", "occupancy_max_pct"), "forbidden"),
    "weather": None,
}


@query(
    "F25_feature_guard",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {f"'{p}'" if p else 'NULL'} AS provenance, {str(p == 'forbidden').lower()} AS forbidden, count({c}) AS filled FROM trip_facts"
        for c, p in _GUARDED.items()
    ),
)
def _(spark, root):
    """Provenance of offered columns and how many rows fill each; columns known only after departure are marked."""
    facts = frames.trip_facts(spark, root)
    filled = facts.agg(*[F.count(c).alias(c) for c in _GUARDED]).unpivot([], list(_GUARDED), "feature", "filled")
    out = filled.join(Fe.feature_catalogue(spark), "feature", "left")
    forbidden = F.col("feature").isin(*Fe.FORBIDDEN_FEATURES)
    return out.select("feature", F.when(forbidden, "forbidden").otherwise(F.col("provenance")).alias("provenance"), forbidden.alias("forbidden"), "filled")
