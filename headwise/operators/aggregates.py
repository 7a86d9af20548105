"""Aggregate analytics over trips, stop visits and rides."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions.nullsafe import join_groups
from headwise.functions import scalars as X
from headwise.functions.quantiles import exact_quantile_scalar, exact_quantiles
from headwise.functions.scans import global_rank
from headwise.operators.features import calendar_windows

T = S.DEFAULTS
Keep = Callable[[DataFrame, str], DataFrame] | None
SCHED, ACTUAL, DELAY = "scheduled_headway_min", "actual_headway_min", "departure_delay_min"


def valid_headway(t: S.Thresholds = T) -> Column:
    return (F.col(SCHED) > t.min_valid_headway) & F.col(ACTUAL).isNotNull()


def bunched(t: S.Thresholds = T) -> Column:
    return valid_headway(t) & (F.col(ACTUAL) < t.bunching_ratio * F.col(SCHED))


def gapped(t: S.Thresholds = T) -> Column:
    return valid_headway(t) & (F.col(ACTUAL) > t.gapping_ratio * F.col(SCHED))


def late() -> Column:
    return F.col("delay_severity").isin("severe", "critical")


def route_base(trips: DataFrame, t: S.Thresholds = T, keep: Keep = None) -> DataFrame:
    """Counts, means, shares and headway spread per route, in one aggregation plus the exact 90th percentile."""
    n_valid = F.greatest(X.count_if(valid_headway(t)), F.lit(1))
    aggs = [
        F.count(F.lit(1)).alias("trips"),
        F.avg(DELAY).alias("avg_delay_min"),
        X.share(F.col("on_time")).alias("on_time_share"),
        F.avg("occupancy_avg_pct").alias("occupancy_avg_pct"),
        F.avg("occupancy_max_pct").alias("occupancy_max_pct"),
        X.share(F.col("occupancy_max_pct") >= t.crowding_high * 100).alias("crowding_share"),
        X.share(F.col("occupancy_max_pct") >= t.crowding_critical * 100).alias("critical_crowding_share"),
        X.share(F.col("occupancy_avg_pct") <= t.underutilization_max * 100).alias("underutilized_share"),
        F.avg("scheduled_travel_min").alias("avg_scheduled_travel_min"),
        F.avg("actual_travel_min").alias("avg_actual_travel_min"),
        F.avg(SCHED).alias("avg_headway_min"),
        F.coalesce(F.stddev_samp(SCHED), X.dbl(0.0)).alias("headway_std_min"),
        X.ratio(F.stddev_samp(SCHED), F.avg(SCHED)).alias("headway_cv"),
        X.share(late()).alias("severe_critical_share"),
        X.share(F.col(DELAY).between(-t.adherence_minutes, t.adherence_minutes)).alias("adherence_share"),
        (X.count_if(bunched(t)) / n_valid).alias("bunching_share"),
        (X.count_if(gapped(t)) / n_valid).alias("gapping_share"),
    ]
    return exact_quantiles(trips, ["route_id"], DELAY, {"p90_delay_min": 0.9}, aggs=aggs, keep=keep)


def bunching_shares(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Collapsed and stretched headways per route, counted over valid headways only."""
    out = trips.groupBy("route_id").agg(
        X.count_if(valid_headway(t)).alias("valid_headway"),
        X.count_if(bunched(t)).alias("bunched_trips"),
        X.count_if(gapped(t)).alias("gapped_trips"),
    )
    n = F.greatest("valid_headway", F.lit(1))
    return out.withColumns({"bunching_share": F.col("bunched_trips") / n, "gapping_share": F.col("gapped_trips") / n})


def route_volume(rides: DataFrame) -> DataFrame:
    return rides.groupBy("route_id").agg(F.count(F.lit(1)).alias("passengers"), F.sum("fare").alias("revenue"))


def with_volume(base: DataFrame, rides: DataFrame) -> DataFrame:
    """Volume and revenue per route joined to the trip metrics, none = 0."""
    out = join_groups(base, route_volume(rides), ["route_id"], "left")
    return out.withColumns(
        {
            "passengers": F.coalesce("passengers", F.lit(0).cast("long")),
            "revenue": F.coalesce("revenue", X.dbl(0.0)),
            "avg_boardings_per_trip": X.ratio(F.coalesce("passengers", F.lit(0).cast("long")), "trips"),
        }
    )


def score_parts(df: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """0..100 component scores, the weighted route score and its class."""
    top = df.agg(F.max("passengers").cast("double")).scalar()
    target = t.occupancy_target
    out = df.withColumns(
        {
            "occupancy_score": X.clip100(
                X.dbl(100.0) - F.abs(F.col("occupancy_avg_pct") - X.dbl(target)) * X.dbl(100.0 / target)
            ),
            "reliability_score": F.col("on_time_share") * 100,
            "adherence_score": F.col("adherence_share") * 100,
            "delay_score": X.delay_score("avg_delay_min", t),
            "bunching_score": X.clip100(X.dbl(100.0) - F.col("bunching_share") * 100),
            "demand_score": X.clip100(X.ratio(F.col("passengers") * 100, top)),
        }
    )
    parts = {n: F.col(f"{n}_score") for n in S.SCORE_WEIGHTS}
    out = out.withColumn("route_score", X.weighted_score(parts, S.SCORE_WEIGHTS, clamp=False))
    return out.withColumn("route_class", X.score_class("route_score"))


def rank_by_score(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """Rank by a 0..100 score, best first, key breaks ties; ordered per half-point band, not in one task."""
    band = F.coalesce(-F.floor(F.col(score) * 2), F.lit(1))
    return global_rank(df, [F.col(score).desc_nulls_last(), F.col(key)], band, name)


def route_reference(trip_facts: DataFrame, routes: DataFrame) -> DataFrame:
    """Route attributes as seen on the trips (earliest trip wins), with names."""
    first = trip_facts.groupBy("route_id").agg(
        F.min_by(F.struct("route_category", "route_length_km"), F.col("trip_id")).alias("_a")
    )
    attrs = first.select(
        "route_id", F.col("_a.route_category").alias("category"), F.col("_a.route_length_km").alias("length_km")
    )
    return attrs.join(routes.select("route_id", "route_name"), "route_id", "left")


def route_metrics(
    trips: DataFrame, rides: DataFrame, reference: DataFrame, t: S.Thresholds = T, keep: Keep = None
) -> DataFrame:
    """The full route scorecard. ``keep`` persists the per-route figures, which scoring and ranking read repeatedly."""
    out = with_volume(route_base(trips, t, keep), rides).join(reference, "route_id", "left")
    out = keep(out, "route_volume") if keep else out
    return rank_by_score(score_parts(out, t), "route_score", "route_id", "route_rank")


def stop_base(visits: DataFrame, t: S.Thresholds = T, keep: Keep = None) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("visits"),
        F.sum("boarded").alias("boardings"),
        F.sum("alighted").alias("alightings"),
        F.avg("arr_delay_min").alias("avg_arr_delay_min"),
        X.share(F.col("arr_delay_min") <= t.on_time_max).alias("on_time_share"),
        X.share(F.col("occupancy_after") >= t.crowding_high).alias("crowding_share"),
        F.avg("dwell_sec").alias("avg_dwell_sec"),
        F.avg("onboard_after").alias("peak_onboard_avg"),
    ]
    return exact_quantiles(visits, ["stop_id"], "arr_delay_min", {"p95_arr_delay_min": 0.95}, aggs=aggs, keep=keep)


def peak_hour(visits: DataFrame, key: str = "stop_id", hour: str = "hour", value: str = "boarded") -> DataFrame:
    """Hour with the largest sum per key (earliest on ties) and that sum."""
    hourly = visits.groupBy(key, hour).agg(F.sum(value).alias("_sum"))
    best = hourly.groupBy(key).agg(F.max_by(F.struct(hour, "_sum"), F.struct("_sum", -F.col(hour))).alias("_b"))
    return best.select(key, F.col(f"_b.{hour}").alias("peak_hour"), F.col("_b._sum").alias("max_hourly_boardings"))


def bottlenecks(stop_frame: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Bottleneck score and flag, low-visit (terminal) flag; the cut points are scalar percentiles over all stops."""
    top = F.greatest(stop_frame.agg(F.max("boardings").cast("double")).scalar(), X.dbl(1.0))
    delay = F.least(F.col("p95_arr_delay_min") / 20.0, X.dbl(1.0))
    volume = F.col("boardings") / top
    raw = X.dbl(100.0) * (X.dbl(0.4) * delay + X.dbl(0.3) * F.col("crowding_share") + X.dbl(0.3) * volume)
    out = stop_frame.withColumn("bottleneck_score", X.clip100(raw))
    cut = exact_quantile_scalar(out, "bottleneck_score", t.bottleneck_percentile)
    low = exact_quantile_scalar(stop_frame, "visits", t.terminal_percentile)
    return out.withColumns({"is_bottleneck": F.col("bottleneck_score") >= cut, "is_terminal": F.col("visits") <= low})


def stop_metrics(visits: DataFrame, stops: DataFrame, t: S.Thresholds = T, keep: Keep = None) -> DataFrame:
    out = join_groups(stop_base(visits, t, keep), peak_hour(visits), ["stop_id"], "left")
    out = keep(out, "stop_figures") if keep else out
    return bottlenecks(out, t).join(stops.select("stop_id", "stop_name", "zone"), "stop_id", "left")


def stop_time_bands(visits: DataFrame, t: S.Thresholds = T, stops: DataFrame | None = None) -> DataFrame:
    """Visits of each stop and band; with ``stops``, also the stop's name and zone."""
    bands = visits.groupBy("stop_id", "time_band").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum("boarded").alias("boardings"),
        F.sum("alighted").alias("alightings"),
        F.avg("arr_delay_min").alias("avg_arr_delay_min"),
        X.share(F.col("occupancy_after") >= t.crowding_high).alias("crowding_share"),
    )
    return bands if stops is None else bands.join(stops.select("stop_id", "stop_name", "zone"), "stop_id", "left")


def daily_demand(rides: DataFrame) -> DataFrame:
    d = rides.groupBy("route_id", "date").agg(
        F.count(F.lit(1)).alias("passengers"),
        F.sum("fare").alias("revenue"),
        F.avg("travel_min").alias("avg_travel_min"),
    )
    return d.select("*", (F.weekday("date") >= 5).alias("is_weekend"), F.month("date").alias("month"))


def band_shares(rides: DataFrame) -> DataFrame:
    """Rides per (route, band) and the band's share of its route."""
    tb = rides.where(F.col("time_band").isin(*S.TIME_BANDS)).groupBy("route_id", "time_band").agg(
        F.count(F.lit(1)).alias("passengers")
    )
    whole = F.sum("passengers").over(W.partitionBy("route_id"))  # at most one row per band here
    return tb.withColumn("band_share", F.col("passengers") / F.greatest(whole, F.lit(1)))


def peak_patterns(rides: DataFrame) -> DataFrame:
    """Band shares with the primary and secondary peak band of the route (name breaks ties)."""
    tb = band_shares(rides)
    place = F.row_number().over(W.partitionBy("route_id").orderBy(F.col("band_share").desc(), "time_band"))
    top = tb.withColumn("_rn", place).groupBy("route_id").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("time_band"))).alias("primary_peak"),
        F.coalesce(F.max(F.when(F.col("_rn") == 2, F.col("time_band"))), F.lit("")).alias("secondary_peak"),
    )
    return tb.join(top, "route_id", "left")


def peak_hours_city(rides: DataFrame, hour: str = "hour", n: int = 3) -> DataFrame:
    """The n busiest hours of the whole network as one sorted list."""
    top = rides.groupBy(hour).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), hour).limit(n)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(hour)), lambda h: h.cast("string")), ", ")
    return top.agg(F.concat(F.lit("["), listed, F.lit("]")).alias("value")).select(
        F.lit("peak_hours_city_wide").alias("key"), "value"
    )


def anomalies(daily: DataFrame, key: str = "route_id", value: str = "passengers", t: S.Thresholds = T) -> DataFrame:
    """Days whose volume is more than ``anomaly_zscore`` sample deviations from the series' own mean."""
    stats = daily.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = X.ratio(F.col(value) - F.col("_m"), F.nullif(F.col("_s"), X.dbl(0.0)))
    out = daily.join(stats, key).withColumn("z_score", z).drop("_m", "_s")
    out = out.where(F.abs("z_score") > t.anomaly_zscore)
    return out.withColumn("anomaly_type", F.when(F.col("z_score") > 0, "high demand").otherwise("low demand"))


def complete_days(daily: DataFrame, date: str, columns: dict[str, Column]) -> DataFrame:
    """One row for every calendar day between the first and the last; missing values take the given fill."""
    span = daily.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.where(F.col("_a").isNotNull()).select(F.explode(F.sequence("_a", "_b")).alias(date))
    return days.join(daily, date, "left").withColumns({c: F.coalesce(F.col(c), fill) for c, fill in columns.items()})


def event_impact(rides: DataFrame, delays: DataFrame, events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Event-day demand and delay against the mean of the seven days before.

    Events on a day outside the series, or with no day before it, are left out.
    """
    demand = rides.groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("demand"))
    by_day = delays.groupBy("date").agg(F.avg(delay).alias("delay"))
    overall = delays.agg(F.avg(delay)).scalar()
    series = complete_days(demand, "date", {"demand": X.dbl(0.0)})
    series = series.join(by_day, "date", "left").withColumn("delay", F.coalesce("delay", overall))
    day = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    w = W.orderBy("_day").rangeBetween(-7, -1)  # one row per calendar day of the whole network
    series = series.withColumn("_day", day).select(
        "date", "demand", "delay", F.avg("demand").over(w).alias("_bd"), F.avg("delay").over(w).alias("_bl")
    )
    hit = events.join(series, "date").where(F.col("_bd").isNotNull())

    def pct(now: str, base: str) -> Column:
        return F.coalesce((X.ratio(now, base) - X.dbl(1.0)) * 100, X.dbl(0.0))

    return hit.select(
        "event_id",
        "date",
        "zone",
        F.col("demand_multiplier").alias("expected_multiplier"),
        F.col("demand").alias("actual_demand"),
        F.col("_bd").alias("baseline_demand"),
        F.when(F.col("_bd") > 0, pct("demand", "_bd")).otherwise(X.dbl(0.0)).alias("demand_delta_pct"),
        F.col("delay").alias("actual_avg_delay"),
        F.col("_bl").alias("baseline_avg_delay"),
        pct("delay", "_bl").alias("delay_delta_pct"),
    )


def zone_flow(rides: DataFrame) -> DataFrame:
    return rides.groupBy("boarding_zone", "alighting_zone").agg(
        F.count(F.lit(1)).alias("passengers"), F.avg("fare").alias("avg_fare"), F.sum("fare").alias("revenue")
    )


def od_matrix(rides: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rides.groupBy(*keys).agg(F.count(F.lit(1)).alias("passengers"))


def od_levels(rides: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Origin-destination counts at several levels from one scan: ``level``, all key columns, passengers.

    A column that a level leaves out is null there; ``grouping_id`` tells it from a null key.
    """
    names = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    out = rides.groupingSets([list(cols) for cols in levels.values()], *names).agg(F.count(F.lit(1)).alias("passengers"), F.grouping_id().alias("_id"))
    ids = {name: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in cols) for name, cols in levels.items()}
    level = F.coalesce(*[F.when(F.col("_id") == i, name) for name, i in ids.items()])
    return out.select(level.alias("level"), *names, "passengers")


def top_pairs(od: DataFrame, keys: Sequence[str], n: int = 30) -> DataFrame:
    return od.orderBy(F.col("passengers").desc(), *keys).limit(n)


def overcrowding_events(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """(route, date, band) cells where at least a fifth of the trips were crowded."""
    g = trips.groupBy("route_id", "date", "time_band").agg(
        F.count(F.lit(1)).alias("trips_total"),
        X.count_if(F.col("occupancy_max_pct") >= t.crowding_high * 100).alias("crowded_trips"),
        X.count_if(F.col("occupancy_max_pct") >= t.crowding_critical * 100).alias("critical_trips"),
        F.avg("occupancy_max_pct").alias("avg_occupancy_max_pct"),
    )
    g = g.withColumns(
        {
            "crowded_share": F.col("crowded_trips") / F.col("trips_total"),
            "critical_share": F.col("critical_trips") / F.col("trips_total"),
        }
    ).where(F.col("crowded_share") >= t.crowded_trip_share)
    critical = (F.col("crowded_share") >= t.critical_trip_share) | (F.col("critical_trips") > 0)
    return g.withColumn("severity", F.when(critical, "critical").otherwise("high"))


def persistent_overcrowding(events: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Routes crowded on at least ``persistent_crowding_min_days`` distinct days."""
    per_day = events.groupBy("route_id", "date").agg(
        F.sum("trips_total").alias("_trips"),
        F.max((F.col("severity") == "critical").cast("long")).alias("_critical"),
        F.collect_set("time_band").alias("_bands"),
    )
    out = per_day.groupBy("route_id").agg(
        F.sum("_trips").alias("all_crowded_trips"),
        F.count(F.lit(1)).alias("crowded_days"),
        F.sum("_critical").alias("critical_days"),
        *[F.max(F.array_contains("_bands", b).cast("int")).alias(f"_b{i}") for i, b in enumerate(S.TIME_BANDS)],
    )
    bands = F.array_compact(F.array(*[F.when(F.col(f"_b{i}") == 1, F.lit(b)) for i, b in enumerate(S.TIME_BANDS)]))
    return out.where(F.col("crowded_days") >= t.persistent_crowding_min_days).select(
        "route_id",
        "all_crowded_trips",
        "crowded_days",
        F.array_join(F.array_sort(bands), ", ").alias("peak_crowding_bands"),
        "critical_days",
    )


def underutilization(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """(route, band) cells where at least half of the trips stay nearly empty."""
    g = trips.groupBy("route_id", "time_band").agg(
        F.count(F.lit(1)).alias("trips_total"),
        X.count_if(F.col("occupancy_max_pct") <= t.underutilization_max * 100).alias("underused_trips"),
        F.avg("occupancy_max_pct").alias("avg_occupancy_pct"),
        F.avg("boardings").alias("avg_boardings"),
    )
    g = g.withColumn("underused_share", F.col("underused_trips") / F.col("trips_total"))
    return g.where(F.col("underused_share") >= t.underused_trip_share)


def bunching_events(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    return trips.where(bunched(t)).groupBy("route_id", "date", "time_band").agg(
        F.count(F.lit(1)).alias("bunched_trips"), F.avg(F.col(ACTUAL) / F.col(SCHED)).alias("avg_headway_ratio")
    )


def quality_days(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Daily reliability per route: on-time share blended with the delay score, and a three-state status."""
    g = trips.groupBy("route_id", "date").agg(
        F.count(F.lit(1)).alias("trips_total"),
        X.count_if(F.col("on_time")).alias("on_time_trips"),
        F.avg(DELAY).alias("avg_delay_min"),
        X.count_if(late()).alias("severe_trips"),
    )
    g = g.withColumns(
        {"on_time_share": F.col("on_time_trips") / F.col("trips_total"), "delay_score": X.delay_score("avg_delay_min", t)}
    )
    return g.withColumns(
        {
            "quality_score": X.dbl(0.7) * F.col("on_time_share") * 100 + X.dbl(0.3) * F.col("delay_score"),
            "status": reliability_state("on_time_share", t),
        }
    )


def reliability_state(share: str | Column, t: S.Thresholds = T) -> Column:
    return X.label_cuts(share, (t.reliability_critical, t.reliability_degraded), ("critical", "degraded", "healthy"))


def segmentation(rides: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Per passenger: volume, peak share, means, spend, active days, usual pass and a rule-based segment."""
    g = rides.groupBy("passenger_id").agg(
        F.count(F.lit(1)).alias("trips"),
        X.share(F.col("time_band").isin(*S.PEAK_BANDS)).alias("peak_share"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg("travel_min").alias("avg_travel_min"),
        F.sum("fare").alias("total_spend"),
        F.count_distinct("date").alias("active_days"),
        F.mode("pass_type", deterministic=True).alias("primary_pass_type"),
    )
    frequent = F.col("trips") >= t.frequent_trips_min
    segment = (
        F.when(frequent & (F.col("peak_share") >= t.peak_share_min), "commuter")
        .when(frequent, "frequent")
        .when(F.col("trips") >= t.regular_trips_min, "regular")
        .when(F.col("trips") >= t.occasional_trips_min, "occasional")
        .otherwise("rare")
    )
    return g.withColumn("segment", segment)


def segment_summary(segments: DataFrame) -> DataFrame:
    """Segment sizes and means in fixed order, with their share of all passengers."""
    out = segments.groupBy("segment").agg(
        F.count(F.lit(1)).alias("passengers"),
        F.avg("trips").alias("avg_trips"),
        F.avg("peak_share").alias("avg_peak_share"),
        F.avg("avg_distance_km").alias("avg_distance_km"),
        F.avg("total_spend").alias("avg_spend"),
    )
    whole = F.sum("passengers").over(W.partitionBy())  # five rows
    place = X.code_of("segment", {s: i for i, s in enumerate(S.SEGMENT_ORDER)})
    return out.select("*", (F.col("passengers") / whole).alias("share_of_passengers"), place.alias("segment_order"))


def headway_reliability(trips: DataFrame, keys: Sequence[str], t: S.Thresholds = T) -> DataFrame:
    """Share of headways within the tolerance of the schedule, over trips that have both."""
    has = (F.col(SCHED) > 0) & F.col(ACTUAL).isNotNull()
    lo, hi = (1 - t.headway_tolerance) * F.col(SCHED), (1 + t.headway_tolerance) * F.col(SCHED)
    return trips.where(has).groupBy(*keys).agg(X.share(F.col(ACTUAL).between(lo, hi)).alias("headway_reliability"))


def _reliable(t: S.Thresholds) -> Column:
    """1/0 within tolerance, null where a headway is missing, so that avg() skips it."""
    has = (F.col(SCHED) > 0) & F.col(ACTUAL).isNotNull()
    lo, hi = (1 - t.headway_tolerance) * F.col(SCHED), (1 + t.headway_tolerance) * F.col(SCHED)
    return F.when(has, F.col(ACTUAL).between(lo, hi).cast("double"))


def frequency_analysis(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Service frequency per (route, date, period) in one aggregation."""
    f = trips.groupBy("route_id", "date", F.col("time_band").alias("time_period")).agg(
        F.count(F.lit(1)).alias("scheduled_trips"),
        F.avg(SCHED).alias("avg_scheduled_headway_min"),
        F.avg(ACTUAL).alias("avg_actual_headway_min"),
        F.stddev_samp(SCHED).alias("headway_std_min"),
        F.avg(_reliable(t)).alias("headway_reliability"),
    )
    return f.select(
        "*",
        (X.ratio("scheduled_trips", "avg_scheduled_headway_min") * 60).alias("trips_per_hour"),
        X.ratio("headway_std_min", "avg_scheduled_headway_min").alias("headway_cv"),
        (F.col("avg_actual_headway_min") - F.col("avg_scheduled_headway_min")).alias("service_gap_min"),
        F.weekday("date").alias("weekday"),
        F.month("date").alias("month"),
        (F.weekday("date") >= 5).alias("is_weekend"),
    )


def headway_analysis(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Headway distribution per (route, period)."""
    h = trips.groupBy("route_id", F.col("time_band").alias("time_period")).agg(
        F.avg(SCHED).alias("scheduled_mean"),
        F.stddev_samp(SCHED).alias("scheduled_std"),
        F.avg(ACTUAL).alias("actual_mean"),
        F.stddev_samp(ACTUAL).alias("actual_std"),
        F.min(ACTUAL).alias("min_headway"),
        F.max(ACTUAL).alias("max_headway"),
        F.count(F.lit(1)).alias("trips"),
        F.avg(_reliable(t)).alias("headway_reliability"),
        X.share(F.col("on_time")).alias("on_time_rate"),
    )
    return h.withColumn("headway_cv", X.ratio("scheduled_std", "scheduled_mean"))


def service_level(trips: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Frequency rows with the regularity and reliability of their (route, period)."""
    level = headway_analysis(trips, t).select(
        "route_id", "time_period", "headway_reliability", "on_time_rate",
        F.col("headway_cv").alias("period_headway_cv"),
    )
    out = join_groups(frequency_analysis(trips, t).drop("headway_reliability"), level, ["route_id", "time_period"], "left")
    out = out.withColumn("service_regularity", (X.dbl(1.0) - X.clip("period_headway_cv", 0.0, 1.0)) * 100)
    composite = (
        X.dbl(0.4) * F.coalesce("on_time_rate", X.dbl(0.0))
        + X.dbl(0.3) * F.coalesce("headway_reliability", X.dbl(0.0))
        + X.dbl(0.3) * F.coalesce("service_regularity", X.dbl(50.0)) / 100
    )
    return out.withColumn("service_reliability", composite * 100)


def hour_pivot(trips: DataFrame) -> DataFrame:
    """Trips per hour as 24 columns per route."""
    return trips.groupBy("route_id").agg(
        *[X.count_if(F.col("hour") == h).alias(f"h{h:02d}") for h in range(24)]
    )


def peak_frequency(trips: DataFrame) -> DataFrame:
    """Trips in and out of the peak hours, and their ratio."""
    peak = F.col("hour").isin(*S.PEAK_HOURS)
    out = trips.groupBy("route_id").agg(X.count_if(peak).alias("peak_freq"), X.count_if(~peak).alias("offpeak_freq"))
    return out.withColumn("peak_ratio", X.ratio("peak_freq", "offpeak_freq"))


def extreme_hours(trips: DataFrame, n: int = 3) -> DataFrame:
    """Busiest and quietest hours per route, as lists in order of rank (earlier hour breaks ties)."""
    hourly = trips.groupBy("route_id", "hour").agg(F.count(F.lit(1)).alias("_n"))  # at most 24 rows per route
    w = W.partitionBy("route_id")
    ranked = hourly.select(
        "route_id",
        "hour",
        F.row_number().over(w.orderBy(F.col("_n").desc(), "hour")).alias("_hi"),
        F.row_number().over(w.orderBy("_n", "hour")).alias("_lo"),
    )

    def listed(rank: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col(rank) <= n, F.struct(rank, "hour"))))
        return F.array_join(F.transform(rows, lambda r: r["hour"].cast("string")), ", ")

    return ranked.groupBy("route_id").agg(listed("_hi").alias("peak_hours"), listed("_lo").alias("offpeak_hours"))


def reliability_profile(trips: DataFrame, t: S.Thresholds = T, keep: Keep = None) -> DataFrame:
    """Reliability profile per route; rates in percent, population spread of the scheduled headway."""
    fits = F.col(SCHED) > t.min_valid_headway
    close = fits & (F.col(ACTUAL) < t.bunching_ratio * F.col(SCHED))
    aggs = [
        F.count(F.lit(1)).alias("trips"),
        F.count_distinct("date").alias("active_days"),
        F.coalesce(F.avg(DELAY), X.dbl(0.0)).alias("avg_delay_min"),
        (X.share(F.col("on_time")) * 100).alias("on_time_rate"),
        (X.share(late()) * 100).alias("severe_rate"),
        F.coalesce(F.stddev_pop(SCHED), X.dbl(0.0)).alias("headway_std"),
        (X.ratio(X.count_if(close), X.count_if(fits)) * 100).alias("bunching_rate"),
        F.avg("occupancy_max_pct").alias("avg_occupancy_max_pct"),
    ]
    out = exact_quantiles(trips, ["route_id"], DELAY, {"p90_delay_min": 0.9}, aggs=aggs, keep=keep)
    out = out.withColumns(
        {
            "p90_delay_min": F.coalesce("p90_delay_min", X.dbl(0.0)),
            "reliability_flag": reliability_state(F.col("on_time_rate") / 100, t),
            "delay_score": X.delay_score("avg_delay_min", t),
        }
    )
    return out.withColumn("quality_score", X.dbl(0.7) * F.col("on_time_rate") + X.dbl(0.3) * F.col("delay_score"))


def band_punctuality(visits: DataFrame, t: S.Thresholds = T) -> DataFrame:
    """Arrival delay and load per (route, band)."""
    return visits.groupBy("route_id", "time_band").agg(
        F.count(F.lit(1)).alias("observations"),
        F.coalesce(F.avg("arr_delay_min"), X.dbl(0.0)).alias("avg_arr_delay_min"),
        (X.share(F.col("arr_delay_min") > t.on_time_max) * 100).alias("late_share"),
        F.avg("onboard_after").alias("avg_onboard"),
        F.avg("occupancy_after").alias("avg_occupancy"),
    )


def fleet_profile(trip_facts: DataFrame, category: str = "vehicle_type", value: str = "occupancy_max_pct") -> DataFrame:
    """Load distribution per vehicle category, and mean trips per vehicle and day (two-level aggregation)."""
    aggs = [F.count(F.lit(1)).alias("trips"), F.avg(value).alias("mean_load")]
    load = exact_quantiles(trip_facts, [category], value, {"p90_load": 0.9, "p99_load": 0.99}, aggs=aggs)
    per_day = trip_facts.groupBy(category, "vehicle_id", "date").agg(F.count(F.lit(1)).alias("_n"))
    pace = per_day.groupBy(category).agg(F.avg("_n").alias("trips_per_vehicle_day"))
    return load.join(pace, category)


def trailing_baseline(daily: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Seven-day calendar baseline next to each day of a series."""
    return calendar_windows(daily, keys, "date", value)
