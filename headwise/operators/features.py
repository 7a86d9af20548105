"""Feature operators: encodings, lags, rolling and expanding statistics that never look ahead."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions.nullsafe import join_groups
from headwise.functions import scalars as X
from headwise.functions.quantiles import exact_quantiles
from headwise.functions.scans import (
    CHUNK, HEAVY_ROWS, chunk_carries, heavy_buckets, is_heavy, previous_values, prior_aggregates, prior_levels, tails_before, trailing_means,
    with_group,
)
from headwise.session import materialise

NOISE = 1e-12  # variance below this share of the mean square is rounding noise


def headway(us: str, prev_us: str) -> Column:
    """Minutes since the previous departure, from microsecond clocks."""
    return (F.col(us) - F.col(prev_us)) / X.dbl(6e7)


def gap_to_previous(df: DataFrame, keys: Sequence[str], us: str, tiebreak: str, chunk: Column, name: str) -> DataFrame:
    prev = previous_values(df, keys, [us, tiebreak], chunk, {"_prev_us": us})
    return prev.withColumn(name, headway(us, "_prev_us")).drop("_prev_us")


def position_features(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Position within the sequence in percent, first and last flags."""
    out = with_group(df, [key], F.max(seq).alias("_last"))
    return out.select(
        *df.columns,
        (X.dbl(100.0) * F.col(seq) / F.col("_last")).alias("position_pct"),
        (F.col(seq) == 1).cast("int").alias("is_first"),
        (F.col(seq) == F.col("_last")).cast("int").alias("is_last"),
    )


def with_codes(df: DataFrame, maps: Mapping[str, Mapping] = S.CODE_MAPS) -> DataFrame:
    """``<column>_code`` for every known category column that the frame has."""
    return df.select("*", *[X.code_of(c, m).alias(f"{c}_code") for c, m in maps.items() if c in df.columns])


def trip_features(trip_facts: DataFrame) -> DataFrame:
    """Target-free trip features: calendar parts, cyclical encodings, category codes."""
    out = with_codes(trip_facts).select(
        "*",
        *X.cyclical("hour", 24, "hour"),
        *X.cyclical("weekday", 7, "weekday"),
        *X.cyclical("month", 12, "month"),
        F.col("is_weekend").cast("int").alias("is_weekend_int"),
        F.col("is_peak").cast("int").alias("is_peak_int"),
    )
    names = [
        "trip_id", "route_id", "vehicle_id", "date", "day_type", "day_type_code", "direction", "is_peak_int", "hour",
        "hour_sin", "hour_cos", "weekday", "weekday_sin", "weekday_cos", "month", "month_sin", "month_cos", "season",
        "season_code", "weather", "weather_code", "time_band", "time_band_code", "route_category",
        "route_category_code", "vehicle_type", "vehicle_type_code", "distance_km", "scheduled_travel_min",
        "scheduled_headway_min", "route_length_km", "capacity", "is_weekend_int",
    ]
    return out.select(*[n for n in names if n in out.columns])


def stop_features(stop_facts: DataFrame) -> DataFrame:
    """Stop-visit features: sequence position, cyclical encodings, category codes."""
    out = position_features(stop_facts, "trip_id", "seq")
    out = out.select("*", F.weekday("date").alias("weekday"), F.month("date").alias("month"))
    out = with_codes(out.withColumn("season", X.season("month"))).select(
        "*",
        *X.cyclical("hour", 24, "hour"),
        *X.cyclical("weekday", 7, "weekday"),
        (F.col("weekday") >= 5).cast("int").alias("is_weekend_int"),
    )
    names = [
        "trip_id", "route_id", "stop_id", "seq", "position_pct", "is_first", "is_last", "stop_name", "zone", "date",
        "hour", "hour_sin", "hour_cos", "weekday", "weekday_sin", "weekday_cos", "month", "season", "season_code",
        "time_band", "time_band_code", "is_weekend_int", "boarded", "alighted", "onboard_after",
    ]
    return out.select(*[n for n in names if n in out.columns])


def demand_cells(rides: DataFrame, keys: Sequence[str] = ("route_id", "date", "time_band")) -> DataFrame:
    """Ride counts and means per cell."""
    return rides.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("boardings"),
        F.avg("fare").alias("avg_fare"),
        F.sum("distance_km").alias("passenger_km"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg("travel_min").alias("avg_travel_min"),
    )


def row_lag(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, name: str) -> DataFrame:
    """Value n rows back in a per-day series (a group holds at most one row per day)."""
    return df.withColumn(name, F.lag(value, n).over(W.partitionBy(*keys).orderBy(order)))


def row_rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, name: str) -> DataFrame:
    """Mean of the previous n rows of a per-day series, current row excluded."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn(name, F.avg(value).over(w))


def demand_features(rides: DataFrame) -> DataFrame:
    """Per (route, date, band): volumes, row lag of 7, trailing 7-row mean, encodings."""
    d = demand_cells(rides)
    d = row_lag(d, ["route_id", "time_band"], "date", "boardings", 7, "prev_week_boardings")
    d = row_rolling_mean(d, ["route_id", "time_band"], "date", "boardings", 7, "rolling_7d_boardings")
    d = d.select("*", F.weekday("date").alias("weekday"), F.month("date").alias("month"))
    d = with_codes(d.withColumn("season", X.season("month")))
    return d.select("*", *X.cyclical("weekday", 7, "weekday"), *X.cyclical("month", 12, "month"))


def supply_counts(df: DataFrame, trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scheduled trips per cell joined to the frame, none = 0, plus log1p."""
    served = trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("trips_scheduled"))
    out = df.join(served, list(keys), "left").withColumn(
        "trips_scheduled", F.coalesce("trips_scheduled", F.lit(0).cast("long"))
    )
    return out.withColumn("log_trips_scheduled", X.log_count("trips_scheduled"))


def calendar_lags(
    df: DataFrame, keys: Sequence[str], date: str, value: str, days: Sequence[int] = (1, 2, 7, 14)
) -> DataFrame:
    """Value exactly d calendar days earlier; null over gaps. A group holds one row per day."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(*keys).orderBy("_day")
    out = df.withColumn("_day", day)
    return out.select(*df.columns, *[F.max(value).over(w.rangeBetween(-d, -d)).alias(f"lag{d}_{value}") for d in days])


def calendar_windows(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Mean, median and population std of the previous 7 calendar days, mean of the previous 28; today excluded."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(*keys).orderBy("_day")
    week, month = w.rangeBetween(-7, -1), w.rangeBetween(-28, -1)
    return df.withColumn("_day", day).select(
        *df.columns,
        F.avg(value).over(week).alias(f"roll7_mean_{value}"),
        F.percentile(F.col(value).cast("double"), 0.5).over(week).alias(f"roll7_median_{value}"),
        F.stddev_pop(value).over(week).alias(f"roll7_std_{value}"),
        F.avg(value).over(month).alias(f"roll28_mean_{value}"),
    )


def static_attributes(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Route attributes by key; an unknown category codes as -1."""
    attrs = routes.select(
        "route_id",
        X.code_of("category", S.ROUTE_CATEGORY_CODES, -1).alias("route_category_code"),
        F.col("length_km").alias("route_length_km"),
        F.col("stops_count").alias("route_stops_count"),
    )
    return df.join(attrs, "route_id", "left")


def _moments(value: str) -> dict[str, Column]:
    v = F.col(value).cast("double")
    return {"_s": v, "_q": v * v, "_n": F.lit(1)}


def _mean_std_count(prefix: str, out: str) -> dict[str, Column]:
    """Mean, population std and count from running moments; null mean and std where there is no earlier row."""
    mean, square = X.ratio(f"{prefix}_s", f"{prefix}_n"), X.ratio(f"{prefix}_q", f"{prefix}_n")
    var = square - mean * mean
    std = F.when(var <= square * NOISE, 0.0).otherwise(F.sqrt(F.greatest(var, X.dbl(0.0))))
    return {
        f"{out}_mean": mean,
        f"{out}_std": F.when(F.col(f"{prefix}_n") > 0, std),
        f"{out}_count": F.col(f"{prefix}_n"),
    }


def prior_stats(
    df: DataFrame, keys: Sequence[str], value: str, prefix: str, order: Sequence[str], chunk: Column
) -> DataFrame:
    """Expanding mean, population std and count over strictly earlier rows of the group."""
    out = prior_aggregates(df, keys, order, chunk, sums=_moments(value))
    return out.select(*df.columns, *[c.alias(n) for n, c in _mean_std_count("", prefix).items()])


def prior_stats_levels(
    df: DataFrame, keys: Sequence[str], levels: Mapping[str, Sequence[str]], value: str, order: Sequence[str],
    chunk: Column, source: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """``prior_stats`` at several levels (prefix -> keys) that share their base keys, in one pass over the rows."""
    out = prior_levels(df, keys, levels, order, chunk, sums=_moments(value), source=source, keep=keep)
    cols = [c.alias(n) for level in levels for n, c in _mean_std_count(level, level).items()]
    return out.select(*df.columns, *cols)


def prior_max(df: DataFrame, keys: Sequence[str], value: str, name: str, order: Sequence[str], chunk: Column) -> DataFrame:
    return prior_aggregates(df, keys, order, chunk, maxes={name: F.col(value)})


def prior_rate(df: DataFrame, keys: Sequence[str], flag: Column, name: str, order: Sequence[str], chunk: Column) -> DataFrame:
    """Share of earlier rows with the flag set."""
    one = F.coalesce(flag, F.lit(False)).cast("long")
    out = prior_aggregates(df, keys, order, chunk, sums={"_f": one, "_n": F.lit(1)})
    return out.select(*df.columns, X.ratio("_f", "_n").alias(name))


def rolling_prior_means(
    df: DataFrame, keys: Sequence[str], value: str, windows: Mapping[str, int], order: Sequence[str], chunk: Column
) -> DataFrame:
    return trailing_means(df, keys, order, chunk, value, windows)


def p90_proxy(mean: str, std: str, z: float = 1.2816) -> Column:
    """Upper-tail estimate of a normal with the given mean and std."""
    return F.col(mean) + X.dbl(z) * F.col(std)


def headway_pressure(df: DataFrame, keys: Sequence[str], value: str, name: str = "headway_pressure") -> DataFrame:
    """Group mean headway over own headway; 1 where undefined."""
    out = with_group(df, keys, F.avg(value).alias("_mean"))
    return out.select(*df.columns, F.coalesce(X.ratio("_mean", value), X.dbl(1.0)).alias(name))


def last_event_of_day(route_zones: DataFrame, events: DataFrame) -> DataFrame:
    """Per (route, date) the last event whose zone the route serves."""
    return (
        route_zones.join(events, "zone")
        .groupBy("route_id", "date")
        .agg(F.max_by(F.struct("demand_multiplier", "extra_delay_min"), F.col("ordinal")).alias("_e"))
        .select(
            "route_id",
            "date",
            F.col("_e.demand_multiplier").alias("event_demand_mult"),
            F.col("_e.extra_delay_min").alias("event_extra_delay"),
        )
    )


def event_effects(df: DataFrame, route_zones: DataFrame, events: DataFrame) -> DataFrame:
    return _with_effects(df, last_event_of_day(route_zones, events))


def _with_effects(df: DataFrame, effects: DataFrame) -> DataFrame:
    out = df.join(effects, ["route_id", "date"], "left")
    return out.withColumns(
        {
            "event_demand_mult": F.coalesce("event_demand_mult", X.dbl(1.0)),
            "event_extra_delay": F.coalesce("event_extra_delay", X.dbl(0.0)),
            "has_event": (F.coalesce("event_extra_delay", X.dbl(0.0)) > 0).cast("int"),
        }
    )


def days_since_flag(calendar: DataFrame, date: str, flag: str, name: str, none: float = 365.0) -> DataFrame:
    """Days since the last flagged calendar day strictly before each day (one small row per calendar day)."""
    before = W.orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col(flag), F.col(date)), ignorenulls=True).over(before)
    return calendar.withColumn(name, F.coalesce(F.datediff(date, last).cast("double"), X.dbl(none)))


NO_CHUNK = -(1 << 62)  # before every chunk


def _vehicle_history(
    rows: DataFrame, trips: DataFrame, columns: Callable[[DataFrame], DataFrame], routes: DataFrame, vehicles: DataFrame,
    order: Sequence[str], value: str, keep: Callable[[DataFrame, str], DataFrame], heavy_rows: int,
) -> DataFrame:
    """Trips with the attributes of their route and vehicle and the mean delay of the vehicle's earlier trips, ever and that day.

    The rows are shuffled once, by their vehicle; those of a vehicle with many trips by vehicle and chunk, and only for
    these is there a chunk table. ``rows`` has a chunk (``CHUNK``); ``trips`` the same rows for that table.
    """
    v, own, vehicle = F.col(value).cast("double"), rows.columns, "vehicle_id"
    sums, levels = {"_s": F.col("_v"), "_n": F.lit(1)}, {"vehicle": [vehicle], "day": [vehicle, "date"]}
    buckets = heavy_buckets(trips, vehicle, heavy_rows)
    by, attrs = [vehicle], vehicles.select(vehicle, "vehicle_type", "capacity")
    if buckets:
        heavy, by = is_heavy(vehicle, buckets), [vehicle, "_part"]
        rows = rows.withColumn("_part", F.when(heavy, F.col(CHUNK)).otherwise(F.lit(NO_CHUNK)))
    df = columns(rows.repartition(*by)).withColumn("_at", F.coalesce(CHUNK, F.lit(NO_CHUNK)))
    df = df.select(*rows.columns, "route_id", "date", "us", "_at", v.alias("_v"))
    in_chunk = W.partitionBy(*by, CHUNK)  # a chunk counts as one sum, as in a chunk table, which its first row bears
    df = df.withColumn("_one", F.row_number().over(in_chunk.orderBy(*order)) == 1)
    df = df.select("*", *[F.when(F.col("_one"), F.sum(c).over(in_chunk)).alias(f"_t{n}") for n, c in sums.items()])
    for name, keys in levels.items():
        earlier = W.partitionBy(*by, *[k for k in keys if k not in by]).orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
        df = df.select("*", *[F.sum(f"_t{n}").over(earlier).alias(f"_c_{name}{n}") for n in sums])
    if buckets:
        carry = chunk_carries(trips.where(heavy).withColumn("_v", v), [vehicle], levels, F.col(CHUNK), sums, {})
        carried = [f"_c_{name}{n}" for name in levels for n in sums]
        carry = keep(carry.withColumnsRenamed({c: f"{c}_" for c in carried}), "vehicle_carry")
        df = join_groups(df, carry, [vehicle, CHUNK], "left")
        df = df.withColumns({c: F.coalesce(c, f"{c}_") for c in carried}).drop(*[f"{c}_" for c in carried])
        many = keep(attrs.where(heavy), "heavy_vehicles").withColumnsRenamed({"vehicle_type": "_type", "capacity": "_capacity"})
        few = attrs.withColumn("_part", F.when(~heavy, F.lit(NO_CHUNK)))
        df = df.join(few, by, "left").join(many, vehicle, "left")
        df = df.withColumns({"vehicle_type": F.coalesce("vehicle_type", "_type"), "capacity": F.coalesce("capacity", "_capacity")})
    else:
        df = df.join(attrs, vehicle, "left")
    r = routes.select("route_id", F.col("category").alias("route_category"), F.col("length_km").alias("route_length_km"))
    df = df.join(r, "route_id", "left")
    inside = W.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i{n}") for n, c in sums.items()])

    def mean(level: str) -> Column:
        s, n = (F.col(f"_i{n}") + F.coalesce(f"_c_{level}{n}", F.lit(0)) for n in sums)
        return X.ratio(s, n)

    return df.select(
        *own, "route_category", "route_length_km", "vehicle_type", "capacity", mean("vehicle").alias("vehicle_prior_delay_mean"),
        mean("day").alias("vehicle_date_prior_delay_mean"),
    )


def history_frame(
    sources: DataFrame, columns: Callable[[DataFrame], DataFrame], routes: DataFrame, vehicles: DataFrame, calendar: DataFrame,
    route_zones: DataFrame, events: DataFrame, chunk: Column, keep: Callable[[DataFrame, str], DataFrame],
    t: S.Thresholds = S.DEFAULTS, heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Trip-level training frame: encodings, weather, schedule pressure, events and expanding history.

    Every history column uses strictly earlier departures. ``chunk`` follows the departure clock and is no coarser
    than an hour, so that date, band and peak flag are constant inside it. ``sources`` holds the stored columns of the
    trips and ``columns`` adds those that follow from them: three shuffles move the stored ones (by chunk for the headway,
    by vehicle, by chunk for all else), and what is computed from them follows behind the last. ``keep(df, name)`` writes
    the rows between and the small tables, whose size Spark then knows when it plans their joins with the rows.
    """
    order, delay, moved = ["us", "trip_id"], "departure_delay_min", sources.columns
    trips = columns(sources).withColumn(CHUNK, chunk)
    v = F.col(delay).cast("double")

    placed = trips.select(*moved, CHUNK).repartition(CHUNK)
    rows = previous_values(columns(placed), ["route_id", "date"], order, F.col(CHUNK), {"_prev_us": "us"}, source=trips, keep=keep)
    rows = rows.select(*moved, CHUNK, "_prev_us")
    rows = keep(_vehicle_history(rows, trips, columns, routes, vehicles, order, delay, keep, heavy_rows), "trip_history")
    context = rows.columns[len(moved) + 1 :]

    # the last rows before a chunk come into it as well, for the rolling means
    rolling = {"route_prior_delay_rolling7": 7, "route_prior_delay_rolling28": 28}
    ends = columns(rows.select(*moved, CHUNK)).select(*moved, CHUNK, "route_id", "us")
    ends = tails_before(ends, ["route_id"], order, max(rolling.values()), keep).select(*moved, CHUNK, F.lit(True).alias("_before"))
    df = rows.withColumn("_before", F.lit(False)).unionByName(ends, allowMissingColumns=True).repartition(CHUNK)
    df = columns(df).select(*moved, *context, CHUNK, "_before", "route_id", "date", "us", "time_band", "is_peak", delay)

    # one pass per base key; the levels of a pass differ only in the small chunk table
    route_levels = {
        "route_prior_delay": ["route_id"],
        "route_date_prior_delay": ["route_id", "date"],
        "route_date_peak_prior_delay": ["route_id", "date", "is_peak"],
        "route_timeband_prior_delay": ["route_id", "time_band"],
    }
    flags = {"_ok": (v <= t.on_time_max).cast("long"), "_late": (v > t.moderate_max).cast("long")}
    own = {n: F.when(~F.col("_before"), c) for n, c in {**_moments(delay), **flags}.items()}
    real, width = trips.withColumn("_before", F.lit(False)), df.columns
    df = prior_levels(
        df, ["route_id"], route_levels, order, F.col(CHUNK), sums=own, maxes={"_max": F.when(~F.col("_before"), v)}, source=real, keep=keep
    )
    cols = {n: c for level in route_levels for n, c in _mean_std_count(level, level).items()}
    cols |= {
        "route_date_prior_delay_max": F.col("route_date_prior_delay_max"),
        "route_prior_on_time_rate": X.ratio("route_prior_delay_ok", "route_prior_delay_n"),
        "route_prior_moderate_plus_rate": X.ratio("route_prior_delay_late", "route_prior_delay_n"),
    }
    back = W.partitionBy("route_id", CHUNK).orderBy(*order)
    cols |= {name: F.avg(delay).over(back.rowsBetween(-n, -1)) for name, n in rolling.items()}
    df = df.select(*width, *[c.alias(n) for n, c in cols.items()]).where(~F.col("_before")).drop("_before")
    weather = {"route_weather_prior_delay": ["route_id", "weather"]}
    df = prior_stats_levels(df, ["route_id", "weather"], weather, delay, order, F.col(CHUNK), trips, keep)
    df = prior_stats_levels(df, ["date"], {"network_prior_delay": ["date"]}, delay, order, F.col(CHUNK), trips, keep)
    df = df.withColumnsRenamed(
        {"route_date_prior_delay_count": "route_date_prior_trip_count", "network_prior_delay_count": "network_prior_trip_count"}
    )
    df = df.withColumn("route_prior_delay_p90", p90_proxy("route_prior_delay_mean", "route_prior_delay_std"))
    df = df.drop(
        "route_date_peak_prior_delay_std", "route_date_peak_prior_delay_count", "route_timeband_prior_delay_std",
        "route_timeband_prior_delay_count", "route_weather_prior_delay_std", "route_weather_prior_delay_count", "network_prior_delay_std",
    )

    # what follows from the stored columns, and the small tables
    df = columns(df.drop("route_id", "date", "us", "time_band", "is_peak", delay))
    df = df.withColumn("scheduled_headway_min", headway("us", "_prev_us")).drop("_prev_us", CHUNK)
    pressed = columns(rows).withColumn("scheduled_headway_min", headway("us", "_prev_us"))
    mean = keep(pressed.groupBy("route_id").agg(F.avg("scheduled_headway_min").alias("_mean")), "route_headway")
    df = join_groups(df, mean, ["route_id"], "left")
    df = df.withColumn("headway_pressure", F.coalesce(X.ratio("_mean", "scheduled_headway_min"), X.dbl(1.0))).drop("_mean")
    df = _with_effects(df, keep(last_event_of_day(route_zones, events), "route_events"))
    df = df.join(keep(days_since_flag(calendar, "date", "is_holiday", "days_since_holiday"), "calendar"), "date", "left")
    df = df.select(
        "*",
        *[
            X.code_of(c, S.CODE_MAPS[c], 0).alias(f"{c}_code")
            for c in ("day_type", "weather", "season", "time_band", "route_category", "vehicle_type")
        ],
        F.col("is_peak").cast("int").alias("is_peak_int"),
        F.col("is_weekend").cast("int").alias("is_weekend_int"),
        F.coalesce("is_holiday", F.lit(False)).cast("int").alias("is_holiday_int"),
        (F.hour("scheduled_departure") * 60 + F.minute("scheduled_departure")).alias("minute_of_day"),
        (F.col("weather") == "snow").cast("int").alias("snow_int"),
        (F.col("weather") == "storm").cast("int").alias("storm_int"),
        X.severe_weather("weather", "precip_mm", "temp_c").alias("severe_weather_int"),
        *X.cyclical("hour", 24, "hour"),
        *X.cyclical("weekday", 7, "weekday"),
        *X.cyclical("month", 12, "month"),
    )
    return df.select("*", *X.cyclical("minute_of_day", 1440, "minute_of_day"))


def occupancy_features(trips: DataFrame) -> DataFrame:
    """Occupancy per (route, date, band) with row lag 7, trailing 7-row mean and codes."""
    keys = ["route_id", "time_band"]
    d = trips.groupBy("route_id", "date", "time_band").agg(
        F.avg("occupancy_max_pct").alias("occupancy_max_pct"),
        F.avg("occupancy_avg_pct").alias("occupancy_avg_pct"),
        F.sum("boardings").alias("boardings"),
    )
    d = row_lag(d, keys, "date", "occupancy_max_pct", 7, "prev_week_occupancy_max")
    d = row_rolling_mean(d, keys, "date", "occupancy_max_pct", 7, "rolling_7d_occupancy_max")
    d = d.select("*", F.weekday("date").alias("weekday"), F.month("date").alias("month"))
    d = with_codes(d.withColumn("season", X.season("month")))
    return d.select("*", (F.col("weekday") >= 5).cast("int").alias("is_weekend_int"), *X.cyclical("weekday", 7, "weekday"))


def delay_features(trips: DataFrame, t: S.Thresholds = S.DEFAULTS, keep=None) -> DataFrame:
    """Per (route, date, band): delay level, tail, punctuality, headway spread, lags and trailing means, bunching."""
    keys = ["route_id", "date", "time_band"]
    aggs = [
        F.avg("departure_delay_min").alias("avg_delay_min"),
        X.share(F.col("on_time")).alias("on_time_share"),
        F.avg("scheduled_headway_min").alias("avg_headway_min"),
        F.stddev_samp("scheduled_headway_min").alias("headway_std_min"),
        F.min_by("weather", F.struct("us", "trip_id")).alias("weather"),
        F.min_by("direction", F.struct("us", "trip_id")).alias("direction"),
    ]
    d = exact_quantiles(trips, keys, "departure_delay_min", {"p90_delay_min": 0.9}, aggs=aggs, keep=keep)
    d = d.withColumn("headway_cv", X.ratio("headway_std_min", "avg_headway_min"))
    w = W.partitionBy("route_id", "time_band").orderBy("date")
    series = {"avg_delay_min": "delay", "on_time_share": "on_time", "p90_delay_min": "p90"}
    d = d.select(
        "*",
        *[F.lag(c, n).over(w).alias(f"{s}_lag_{n}") for c, s in series.items() for n in (1, 7, 14)],
        *[F.avg(c).over(w.rowsBetween(-n, -1)).alias(f"{s}_rolling_{n}") for c, s in series.items() for n in (7, 14, 28)],
    )
    valid = (F.col("scheduled_headway_min") > t.min_valid_headway) & F.col("actual_headway_min").isNotNull()
    bunched = valid & (F.col("actual_headway_min") < t.bunching_ratio * F.col("scheduled_headway_min"))
    rate = trips.groupBy("route_id").agg(
        (X.count_if(bunched) / F.greatest(X.count_if(valid), F.lit(1))).alias("route_bunching_rate")
    )
    return join_groups(d, rate, ["route_id"], "left")


def hierarchical_fill(df: DataFrame, fit_on: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null -> group mean -> global mean, both means learned from ``fit_on`` rows only."""
    group = fit_on.groupBy(*keys).agg(*[F.avg(c).alias(f"_g_{c}") for c in columns])
    overall = fit_on.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("_all"))
    out = join_groups(df, group, list(keys), "left").withColumn("_all", overall.scalar())
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_g_{c}"), F.col(f"_all.{c}")) for c in columns}
    return out.withColumns(filled).select(*df.columns)


def shrunk_effects(df: DataFrame, fit_on: DataFrame, value: str, groups: Sequence[str], k: float) -> DataFrame:
    """Signal rebuilt from shrunken group effects, each learned on the residual of the ones before it.

    effect = sum(residual) / (n + k), learned on ``fit_on`` rows only; unseen groups contribute 0.
    """
    overall = fit_on.agg(F.avg(value)).scalar()
    train = fit_on.withColumn("_res", F.col(value) - overall)
    out = df.withColumn("signal", overall)
    for g in groups:
        eff = train.groupBy(g).agg((F.sum("_res") / (F.count("_res") + X.dbl(k))).alias("_eff"))
        out = join_groups(out, eff, [g], "left")
        out = out.withColumn(f"{g}_effect", F.coalesce("_eff", X.dbl(0.0)))
        out = out.withColumn("signal", F.col("signal") + F.col(f"{g}_effect")).drop("_eff")
        train = join_groups(train, eff, [g], "left")
        train = train.withColumn("_res", F.col("_res") - F.coalesce("_eff", X.dbl(0.0))).drop("_eff")
    return out.withColumn("residual", F.col(value) - F.col("signal"))


def backfitted_effects(
    df: DataFrame, fit_on: DataFrame, value: str, groups: Sequence[str], k: float, rounds: int = 50, tolerance: float = 1e-6
) -> DataFrame:
    """Signal rebuilt from shrunken group effects that hold at the same time, whatever the order of the groups.

    One round is the pass of ``shrunk_effects``; the next ones correct each group's effects for the others' newest, until
    none moves by more than ``tolerance``. Between rounds a constant moves from grouping to grouping so that the squared
    effects are least: signals stay as they are, and large groups would take many rounds to agree on it. The limit is
    the ridge solution with penalty ``k``. Rows of ``fit_on`` are read once: a round needs only each group's sum and count
    and, for two groupings, how many rows each pair of groups has in common. Null keys are groups, null values are left
    out, unseen groups contribute 0.
    """
    groups = list(groups)
    overall = fit_on.agg(F.avg(value)).scalar()
    train = fit_on.where(F.col(value).isNotNull()).withColumn("_res", F.col(value) - overall)
    cells = materialise(train.groupBy(*groups).agg(F.sum("_res").alias("_s"), F.count("_res").alias("_n")), "effect-cells")
    own, common = {}, {}
    for i, g in enumerate(groups):
        own[g] = materialise(cells.groupBy(g).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), X.dbl(0.0).alias("_old")), "effect-sums")
        for h in groups[i + 1 :]:
            common[g, h] = common[h, g] = materialise(cells.groupBy(g, h).agg(F.sum("_n").alias("_n")), "effect-pairs")
    effects: dict[str, DataFrame] = {}
    shift: dict[str, float] = {}
    for done in range(1, rounds + 1):
        for g in groups:
            now = own[g]
            for h in (h for h in groups if h != g and h in effects):
                newest = effects[h].select(h, (F.col("_eff") + X.dbl(shift.get(h, 0.0))).alias("_eff"))
                held = join_groups(common[g, h], newest, [h]).groupBy(g).agg(F.sum(F.col("_n") * F.col("_eff")).alias("_held"))
                now = join_groups(now, held, [g], "left").withColumn("_s", F.col("_s") - F.coalesce("_held", X.dbl(0.0))).drop("_held")
            if g in effects:
                before = effects[g].select(g, (F.col("_eff") + X.dbl(shift[g])).alias("_old"))
                now = join_groups(now.drop("_old"), before, [g], "left")
            effects[g] = materialise(now.select(g, (F.col("_s") / (F.col("_n") + X.dbl(k))).alias("_eff"), "_old"), "effects")
            shift.pop(g, None)
        if done < rounds:
            each = [effects[g].agg(F.lit(g).alias("g"), F.avg("_eff"), F.count("_eff"), F.max(F.abs(F.col("_eff") - F.col("_old")))) for g in groups]
            stats = {r["g"]: tuple(r)[1:] for r in reduce(DataFrame.union, each).collect()}  # three numbers a grouping
            if any(n == 0 for _, n, _ in stats.values()) or max(m for _, _, m in stats.values()) <= tolerance:
                break
            common_share = sum(mean for mean, _, _ in stats.values()) / sum(1 / n for _, n, _ in stats.values())
            shift = {g: common_share / n - mean for g, (mean, n, _) in stats.items()}
    out = df.withColumn("signal", overall)
    for g in groups:
        out = join_groups(out, effects[g].select(g, "_eff"), [g], "left").withColumn(f"{g}_effect", F.coalesce("_eff", X.dbl(0.0)))
        out = out.withColumn("signal", F.col("signal") + F.col(f"{g}_effect")).drop("_eff")
    return out.withColumn("residual", F.col(value) - F.col("signal"))


# Provenance of the model features: A known from the timetable, B known on the day, C history before departure.
FEATURE_PROVENANCE = {
    "A": ("direction", "hour", "weekday", "month", "minute_of_day", "is_peak_int", "is_weekend_int", "is_holiday_int",
          "day_type_code", "season_code", "time_band_code", "route_category_code", "vehicle_type_code", "distance_km",
          "scheduled_travel_min", "scheduled_headway_min", "route_length_km", "capacity", "days_since_holiday",
          "headway_pressure"),
    "B": ("weather_code", "snow_int", "storm_int", "severe_weather_int", "precip_mm", "temp_c", "event_demand_mult",
          "event_extra_delay", "has_event"),
    "C": ("route_date_prior_delay_mean", "route_date_prior_delay_std", "route_date_prior_trip_count",
          "route_date_prior_delay_max", "route_date_peak_prior_delay_mean", "vehicle_date_prior_delay_mean",
          "network_prior_delay_mean", "network_prior_trip_count", "vehicle_prior_delay_mean",
          "route_prior_delay_mean", "route_prior_delay_std", "route_prior_delay_count", "route_prior_delay_p90",
          "route_timeband_prior_delay_mean", "route_weather_prior_delay_mean", "route_prior_delay_rolling7",
          "route_prior_delay_rolling28", "route_prior_on_time_rate", "route_prior_moderate_plus_rate"),
}
FORBIDDEN_FEATURES = ("departure_delay_min", "actual_departure", "actual_travel_min", "actual_headway_min", "on_time",
                      "delay_severity", "occupancy_avg_pct", "occupancy_max_pct", "boardings", "alightings", "target")


def check_features(names: Sequence[str]) -> list[str]:
    """Fails when a column that is only known after departure is offered as a feature."""
    leaked = sorted(set(names) & set(FORBIDDEN_FEATURES))
    if leaked:
        raise ValueError(f"columns known only after departure: {', '.join(leaked)}")
    return list(names)


def feature_catalogue(spark):
    rows = [(n, c) for c, names in FEATURE_PROVENANCE.items() for n in names]
    return spark.createDataFrame(rows, "feature string, provenance string")


def feature_manifest(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and category codes of each feature frame."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("frame"),
            "rows",
            F.lit(len(df.columns)).alias("n_columns"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def training_frame(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Key, features and target; rows with a missing target or feature are dropped."""
    check_features(features)
    return df.select(*keys, *features, F.col(target).alias("target")).dropna(subset=[*features, "target"])
