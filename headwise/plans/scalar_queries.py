"""Scalar functions (X), each applied to every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X
from headwise.operators.scaling import min_max
from headwise.plans.catalog import query
from headwise.plans.oracle import BAND, SEASON, SEVERITY, clip100
from headwise.sources import star


@query("X01_time_band", f"SELECT event_id, {BAND.format(h='hour(ts)')} AS time_band FROM events")
def _(spark, root):
    return star.table(spark, root, "events").select("event_id", X.time_band(F.hour("ts")).alias("time_band"))


@query("X02_season", f"SELECT o_orderkey, {SEASON.format(m='month(o_orderdate)')} AS season FROM orders")
def _(spark, root):
    return star.table(spark, root, "orders").select("o_orderkey", X.season(F.month("o_orderdate")).alias("season"))


@query(
    "X03_right_closed_buckets",
    f"SELECT event_id, {SEVERITY.format(d='(value/5 - 5)')} AS delay_severity, CASE WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'mid' ELSE 'high' END AS value_class FROM events",
)
def _(spark, root):
    e = star.table(spark, root, "events")
    return e.select(
        "event_id",
        X.delay_severity(F.col("value") / 5 - 5).alias("delay_severity"),
        X.label_cuts("value", (10, 50), ("low", "mid", "high")).alias("value_class"),
    )


@query(
    "X04_calendar_parts",
    "SELECT event_id, isodow(ts) - 1 AS weekday, month(ts) AS month, isodow(ts) >= 6 AS is_weekend, hour(ts) AS hour, hour(ts)*60 + minute(ts) AS minute_of_day FROM events",
)
def _(spark, root):
    parts = X.calendar_parts("ts")
    return star.table(spark, root, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "X05_cyclical_encoding",
    "SELECT event_id, sin(2*pi()*hour(ts)/24e0) AS hour_sin, cos(2*pi()*hour(ts)/24e0) AS hour_cos, sin(2*pi()*(isodow(ts) - 1)/7e0) AS weekday_sin, cos(2*pi()*(isodow(ts) - 1)/7e0) AS weekday_cos FROM events",
)
def _(spark, root):
    e = star.table(spark, root, "events")
    return e.select("event_id", *X.cyclical(F.hour("ts"), 24, "hour"), *X.cyclical(F.weekday("ts"), 7, "weekday"))


@query(
    "X06_category_codes",
    "SELECT trip_id, CASE weather WHEN 'clear' THEN 0 WHEN 'rain' THEN 1 WHEN 'snow' THEN 2 WHEN 'storm' THEN 3 END AS weather_code, CASE day_type WHEN 'weekday' THEN 0 WHEN 'weekend' THEN 1 WHEN 'holiday' THEN 2 END AS day_type_code FROM trips_core",
)
def _(spark, root):
    t = star.trips_core(spark, root)
    return t.select(
        "trip_id",
        X.code_of("weather", S.WEATHER_CODES).alias("weather_code"),
        X.code_of("day_type", S.DAY_TYPE_CODES).alias("day_type_code"),
    )


@query("X07_clamp_0_100", f"SELECT event_id, {clip100('value*1.5e0 - 20')} AS clamped FROM events")
def _(spark, root):
    return star.table(spark, root, "events").select("event_id", X.clip100(F.col("value") * X.dbl(1.5) - 20).alias("clamped"))


@query(
    "X08_weighted_score",
    f"SELECT trip_id, 0.2e0*{clip100('occupancy_max_pct')} + 0.25e0*{clip100('departure_delay_min*4')} + 0.15e0*{clip100('boardings*1.5e0')} AS score FROM trips_core",
)
def _(spark, root):
    parts = {
        "demand": F.col("occupancy_max_pct"),
        "reliability": F.col("departure_delay_min") * 4,
        "occupancy": F.col("boardings") * X.dbl(1.5),
    }
    return star.trips_core(spark, root).select("trip_id", X.weighted_score(parts, S.SCORE_WEIGHTS).alias("score"))


@query(
    "X09_score_class",
    "SELECT trip_id, CASE WHEN boardings >= 80 THEN 'Top Performer' WHEN boardings >= 65 THEN 'Solid' WHEN boardings >= 50 THEN 'Needs Attention' ELSE 'Action Required' END AS route_class FROM trips_core",
)
def _(spark, root):
    return star.trips_core(spark, root).select("trip_id", X.score_class(F.col("boardings").cast("double")).alias("route_class"))


@query("X10_log1p", "SELECT trip_id, ln(1 + boardings) AS log_boardings FROM trips_core")
def _(spark, root):
    return star.trips_core(spark, root).select("trip_id", X.log_count("boardings").alias("log_boardings"))


@query(
    "X11_severe_weather",
    """SELECT t.trip_id, CAST(t.weather IN ('snow', 'storm') OR c.precip_mm > 10 OR c.temp_c < 0 AS INT) AS severe_weather_int
    FROM trips_core t LEFT JOIN trip_calendar c ON t.date = c.date""",
)
def _(spark, root):
    t = star.trips_core(spark, root).join(star.trip_calendar(spark, root), "date", "left")
    return t.select("trip_id", X.severe_weather("weather", "precip_mm", "temp_c").alias("severe_weather_int"))


@query(
    "X12_safe_division",
    "SELECT trip_id, departure_delay_min/nullif(boardings, 0) AS delay_per_boarding, occupancy_max_pct/greatest(boardings, 1) AS floor_ratio FROM trips_core",
)
def _(spark, root):
    return star.trips_core(spark, root).select(
        "trip_id",
        X.ratio("departure_delay_min", "boardings").alias("delay_per_boarding"),
        (F.col("occupancy_max_pct") / F.greatest("boardings", F.lit(1))).alias("floor_ratio"),
    )


@query(
    "X13_min_max_normalise",
    """SELECT stop_id, CASE WHEN max(boardings) OVER () > min(boardings) OVER () THEN (boardings - min(boardings) OVER ())/(max(boardings) OVER () - min(boardings) OVER ())
    ELSE 0.5e0 END AS weight FROM stop_base""",
)
def _(spark, root):
    s = star.raw_stop_visits(spark, root).groupBy("stop_id").agg(F.sum("boarded").alias("boardings"))
    return min_max(s, "boardings", "weight").select("stop_id", "weight")


@query(
    "X14_text_template",
    "SELECT trip_id, printf('Trip %d on route %d: boardings %d (%s)', trip_id, route_id, boardings, time_band) AS title FROM trips_core",
)
def _(spark, root):
    text = "Trip %d on route %d: boardings %d (%s)"
    parts = {c: c for c in ("trip_id", "route_id", "boardings", "time_band")}
    return star.trips_core(spark, root).select("trip_id", X.template(text, **parts).alias("title"))


@query("X15_percentage", "SELECT route_id, time_band, band_share*100 AS share_pct FROM band_shares")
def _(spark, root):
    from headwise.operators import aggregates as A

    return A.band_shares(star.raw_rides(spark, root)).select("route_id", "time_band", X.percent("band_share", None).alias("share_pct"))


@query("X16_label_to_key", "SELECT p_partkey, replace(replace(lower(trim(p_name || '-' || p_type)), ' ', '_'), '-', '_') AS key FROM part")
def _(spark, root):
    p = star.table(spark, root, "part")
    return p.select("p_partkey", X.canonical_key(F.concat_ws("-", "p_name", "p_type")).alias("key"))


