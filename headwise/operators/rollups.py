"""Report tables, run-log tables, geographic tables and distribution profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X
from headwise.functions.quantiles import exact_quantiles
from headwise.operators.scaling import min_max


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def daily_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.sum("passengers").alias("passengers"))


def daily_total_summary(daily: DataFrame) -> DataFrame:
    return daily_totals(daily).agg(F.avg("passengers").alias("avg_daily"), F.max("passengers").alias("peak_daily"))


def weekday_weekend(daily: DataFrame) -> DataFrame:
    kind = F.when(F.weekday("date") >= 5, "weekend").otherwise("weekday")
    return daily.groupBy(kind.alias("day_kind")).agg(F.avg("passengers").alias("avg_passengers"))


def entity_date_matrix(
    daily: DataFrame, entity: str, value: str, dates: Sequence[str], n: int = 15, agg: str = "sum"
) -> DataFrame:
    """Top-n entities by total as rows, the given dates as columns, gaps as 0."""
    top = daily.groupBy(entity).agg(F.sum(value).alias("_t")).orderBy(F.col("_t").desc(), entity).limit(n)
    fn = {"sum": F.sum, "avg": F.avg}[agg]
    cells = daily.join(top.select(entity), entity, "left_semi").groupBy(entity)
    text = F.col("date").cast("string")
    return cells.agg(
        *[F.coalesce(fn(F.when(text == d, F.col(value))), F.lit(0)).alias(d) for d in dates]
    )


def band_means(shares: DataFrame) -> DataFrame:
    """Mean band share over routes, with the band's place in the day."""
    place = X.code_of("time_band", {b: i for i, b in enumerate(S.TIME_BANDS)})
    return shares.groupBy("time_band").agg(F.avg("band_share").alias("avg_share")).withColumn("band_order", place)


def primary_peak_counts(patterns: DataFrame) -> DataFrame:
    return patterns.select("route_id", "primary_peak").distinct().groupBy("primary_peak").agg(F.count(F.lit(1)).alias("routes"))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    return value_counts(anomalies, "route_id", "anomaly_type")


def strongest_anomalies(anomalies: DataFrame) -> DataFrame:
    """All anomalies, the strongest first."""
    return anomalies.orderBy(F.abs("z_score").desc(), "route_id", "date")


def delay_profile_class(routes: DataFrame) -> DataFrame:
    profile = (
        F.when(F.col("severe_critical_share") > 0.3, "Critical")
        .when(F.col("severe_critical_share") > 0.15, "High")
        .when(F.col("avg_delay_min") > 10, "Moderate")
        .when(F.col("on_time_share") < 0.75, "Degraded")
        .otherwise("Good")
    )
    return routes.withColumn("severity_profile", profile)


def quality_trend(quality: DataFrame) -> DataFrame:
    return quality.groupBy("date").agg(
        F.avg("quality_score").alias("quality_score"),
        F.avg("on_time_share").alias("on_time_share"),
        F.avg("avg_delay_min").alias("avg_delay_min"),
    )


def pressure_class(routes: DataFrame) -> DataFrame:
    top, crowd = F.col("occupancy_max_pct"), F.col("crowding_share")
    pressure = (
        F.when((top >= 100) | (crowd > 0.3), "Critical Pressure")
        .when((top >= 85) | (crowd > 0.2), "High Pressure")
        .when(F.col("underutilized_share") > 0.5, "Underutilized")
        .when(top >= 70, "Moderate Pressure")
        .otherwise("Normal")
    )
    return routes.withColumn("pressure", pressure)


def zone_bottlenecks(stops: DataFrame) -> DataFrame:
    return stops.where("is_bottleneck").groupBy("zone").agg(F.count(F.lit(1)).alias("count"))


def bottleneck_line(stops: DataFrame, p: float = S.DEFAULTS.bottleneck_percentile) -> DataFrame:
    return exact_quantiles(stops, [], "bottleneck_score", {"threshold": p})


def stop_band_means(bands: DataFrame) -> DataFrame:
    return bands.groupBy("time_band").agg(
        F.avg("avg_arr_delay_min").alias("avg_arr_delay"),
        F.avg("crowding_share").alias("crowding_share"),
        F.sum("boardings").alias("total_boardings"),
    )


def frequency_trend(frequency: DataFrame) -> DataFrame:
    return frequency.groupBy("date", "time_period").agg(
        F.avg("trips_per_hour").alias("avg_trips_per_hour"),
        F.avg("headway_reliability").alias("avg_headway_reliability"),
        F.sum("scheduled_trips").alias("total_trips"),
    )


def daily_counts(log: DataFrame, time: str, *columns: str) -> DataFrame:
    return log.groupBy(F.to_date(time).alias("date"), *columns).agg(F.count(F.lit(1)).alias("count"))


def ordered_by_rank(df: DataFrame, column: str, ranks: Mapping[str, int], time: str, *ties: str) -> DataFrame:
    """Custom order of a category first, newest first within it."""
    return df.orderBy(X.code_of(column, ranks, len(ranks)), F.col(time).desc(), *ties)


def prediction_summary(pred: DataFrame, value: str, high: float) -> DataFrame:
    return pred.agg(
        F.count(F.lit(1)).alias("predictions"), F.avg(value).alias("avg_predicted"), F.max(value).alias("max_predicted"),
        F.coalesce(X.count_if(F.col(value) >= high), F.lit(0)).alias("high_count"),
    )


def prediction_means(pred: DataFrame, key: str, *values: str) -> DataFrame:
    return pred.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])


# Run-log tables --------------------------------------------------------------------------------------------------

LOG_SCHEMA = "ts timestamp, action string, component string, status string, details string, duration_ms double"


def append_log(entries: DataFrame, path: str) -> None:
    """Append a batch of run entries; each batch lands as new files."""
    entries.write.mode("append").parquet(path)


def timeline(
    log: DataFrame, action: str | None = None, status: str | None = None, component: str | None = None,
    since: Column | None = None, limit: int | None = None, ties: Sequence[str] = (),
) -> DataFrame:
    """Newest first, filtered by whichever criteria are given."""
    out = log
    for column, value in (("action", action), ("status", status), ("component", component)):
        if value:
            out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    out = out.orderBy(F.col("ts").desc(), *ties)
    return out.limit(limit) if limit else out


def recent(log: DataFrame, hours: int, now: Column) -> DataFrame:
    return log.where(F.col("ts") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def log_kpis(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("activities"),
        (X.share(F.col("status") == "ok") * 100).alias("success_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.count_distinct("component").alias("components"),
    )


def mean_duration(log: DataFrame) -> DataFrame:
    return log.where(F.col("duration_ms").isNotNull()).groupBy("action").agg((F.avg("duration_ms") / 1000).alias("duration_s"))


def weekly_counts(log: DataFrame, time: str = "ts") -> DataFrame:
    """Volumes per Monday-based week."""
    return log.groupBy(F.to_date(F.date_trunc("week", time)).alias("week")).agg(F.count(F.lit(1)).alias("count"))


# Geographic tables -----------------------------------------------------------------------------------------------


def route_geometries(route_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Ordered coordinates per route (a route has at most a few dozen positions); routes with one known stop drop out."""
    points = route_stops.join(stops.select("stop_id", "lat", "lon"), "stop_id")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lat", "lon")))
    out = points.groupBy("route_id").agg(ordered.alias("path"))
    return out.where(F.size("path") >= 2)


def path_text(path: str = "path") -> Column:
    return F.array_join(
        F.transform(path, lambda p: F.concat_ws(":", p["seq"].cast("string"), p["lat"].cast("string"), p["lon"].cast("string"))), "|"
    )


def weighted_points(stops: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """Stop coordinates with the metric scaled to 0..1; incomplete points are left out."""
    df = stops.select("stop_id", "lat", "lon").join(metrics.select("stop_id", metric), "stop_id")
    return min_max(df.dropna(subset=["lat", "lon", metric]), metric, "weight").select("stop_id", "lat", "lon", "weight")


def weighted_points_by_day(stops: DataFrame, metrics: DataFrame, metric: str, pages: int = 64) -> DataFrame:
    """Weighted points per day as lists. A day's points are split over pages by stop, so no list holds a whole day."""
    df = stops.select("stop_id", "lat", "lon").join(metrics.select("stop_id", "date", metric), "stop_id")
    scaled = min_max(df.dropna(subset=["lat", "lon", metric]), metric, "weight")
    page = F.pmod(F.col("stop_id"), F.lit(pages)) if dict(stops.dtypes)["stop_id"] != "string" else F.pmod(F.hash("stop_id"), F.lit(pages))
    points = F.array_sort(F.collect_list(F.struct("stop_id", "lat", "lon", "weight")))
    return scaled.groupBy("date", page.alias("page")).agg(points.alias("points"))


def map_centre(stops: DataFrame) -> DataFrame:
    return stops.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def bottleneck_points(metrics: DataFrame, stops: DataFrame) -> DataFrame:
    return metrics.where("is_bottleneck").select("stop_id", "bottleneck_score").join(stops.select("stop_id", "lat", "lon"), "stop_id")


def segment_lengths(route_stops: DataFrame, stops: DataFrame, km_per_degree: float = 111.0) -> DataFrame:
    """Length of each segment and cumulative length along the route (one row per position)."""
    points = route_stops.join(stops.select("stop_id", "lat", "lon"), "stop_id")
    w = W.partitionBy("route_id").orderBy("seq")
    leg = F.hypot(F.col("lat") - F.lag("lat").over(w), F.col("lon") - F.lag("lon").over(w)) * X.dbl(km_per_degree)
    out = points.withColumn("segment_km", F.coalesce(leg, X.dbl(0.0)))
    total = F.sum("segment_km").over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("cumulative_km", total).drop("lat", "lon")


# Distribution and leakage profiles -------------------------------------------------------------------------------

PROFILE_QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def numeric_profile(df: DataFrame, value: str, at_most: Sequence[float] = (4, 5, 7), above: Sequence[float] = (12,)) -> DataFrame:
    """Count, mean, spread, bounds, nine exact quantiles and threshold shares of a column."""
    base = df.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        *[X.share(F.col(value) <= float(x)).alias(f"share_le_{x:g}") for x in at_most],
        *[X.share(F.col(value) > float(x)).alias(f"share_gt_{x:g}") for x in above],
    )
    names = {f"q{int(round(p * 100)):02d}": p for p in PROFILE_QUANTILES}
    packed = exact_quantiles(df, [], value, names).select(F.struct(*names)).scalar()
    return base.withColumn("_q", packed).select("*", "_q.*").drop("_q")


def mean_by_dimensions(df: DataFrame, value: str, dimensions: Sequence[str]) -> DataFrame:
    """Mean per value of each dimension, all dimensions in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])
    # partial sums per combination first: the fan-out then touches combinations, not rows
    cells = df.groupBy(*dimensions).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    long = cells.select("_s", "_n", F.explode(pairs).alias("_p")).select("_p.*", "_s", "_n")
    return long.groupBy("dimension", "level").agg((F.sum("_s") / F.sum("_n")).alias("mean"))


def squared_correlations(df: DataFrame, target: str, suspects: Mapping[str, Column]) -> DataFrame:
    """r2 of the target with each suspect column, over rows where both are present."""
    return df.agg(*[F.pow(F.corr(F.col(target), c), F.lit(2.0)).alias(name) for name, c in suspects.items()])


def class_counts(df: DataFrame, value: str, sets: Mapping[str, Sequence[float]], split: str) -> DataFrame:
    """Rows per class of each threshold set and split, in one aggregation."""
    labels = ("c0", "c1", "c2", "c3")
    classes = {f"_k{i}": X.label_cuts(value, cuts, labels[: len(cuts) + 1]) for i, cuts in enumerate(sets.values())}
    # rows collapse to the few combinations of classes before the sets are fanned out
    cells = df.select(F.col(split).alias("split"), *[c.alias(n) for n, c in classes.items()]).groupBy("split", *classes).count()
    each = F.array(*[F.struct(F.lit(name).alias("threshold_set"), F.col(f"_k{i}").alias("class")) for i, name in enumerate(sets)])
    long = cells.select("split", "count", F.explode(each).alias("_c")).select("split", "count", "_c.*")
    counts = long.groupBy("threshold_set", "split", "class").agg(F.sum("count").alias("count"))
    whole = F.sum("count").over(W.partitionBy("threshold_set", "split"))
    return counts.withColumn("share", F.col("count") / whole)


def rule_confusion(df: DataFrame, actual: str, estimate: str, cuts: Sequence[float]) -> DataFrame:
    labels = ("c0", "c1", "c2", "c3")
    return df.groupBy(
        X.label_cuts(actual, cuts, labels).alias("actual"), X.label_cuts(estimate, cuts, labels).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("count"))


def majority_baseline(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Accuracy of always answering the larger side, per cut."""
    wide = df.agg(*[X.share(F.col(value) > float(c)).alias(f"d{i}") for i, c in enumerate(cuts)])
    rows = [
        F.struct(X.dbl(c).alias("cut"), F.col(f"d{i}").alias("delayed_rate"), F.greatest(F.col(f"d{i}"), 1 - F.col(f"d{i}")).alias("majority_baseline"))
        for i, c in enumerate(cuts)
    ]
    return wide.select(F.inline(F.array(*rows)))


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "null_share")


def variance_shares(df: DataFrame, target: str, parts: Sequence[str]) -> DataFrame:
    """Sample variance of the target, and the share of it that each part has."""
    row = df.agg(F.var_samp(target).alias("var_total"), *[F.var_samp(p).alias(p) for p in parts])
    return row.select("var_total", *[X.ratio(p, "var_total").alias(f"{p}_share") for p in parts])


def residual_means(df: DataFrame, keys: Sequence[str], residual: str = "residual") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(residual).alias("residual_mean"), F.count(F.lit(1)).alias("rows"))


