"""Entity comparison, ranking, profiles, headline figures and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise.functions import scalars as X
from headwise.functions.quantiles import exact_quantiles

# Metric groups, and per metric its label, number format and direction (None: a target, not a direction).
METRIC_GROUPS = {
    "demand": ("passengers", "revenue", "trips", "avg_boardings_per_trip"),
    "delay": ("avg_delay_min", "p90_delay_min", "on_time_share", "adherence_share", "severe_critical_share"),
    "occupancy": ("occupancy_avg_pct", "occupancy_max_pct", "crowding_share", "critical_crowding_share", "underutilized_share"),
    "travel_time": ("avg_scheduled_travel_min", "avg_actual_travel_min"),
    "headway": ("avg_headway_min", "headway_std_min", "headway_cv", "bunching_share", "gapping_share"),
    "overall": ("route_score", "route_rank", "route_class"),
    "route_info": ("category", "length_km"),
}
METRIC_SPECS = {
    "passengers": ("Total Passengers", "{:,.0f}", True),
    "revenue": ("Revenue", "${:,.0f}", True),
    "trips": ("Total Trips", "{:,.0f}", True),
    "avg_boardings_per_trip": ("Avg Boardings/Trip", "{:.1f}", True),
    "avg_delay_min": ("Avg Delay (min)", "{:.1f}", False),
    "p90_delay_min": ("P90 Delay (min)", "{:.1f}", False),
    "on_time_share": ("On-Time %", "{:.1%}", True),
    "adherence_share": ("Adherence % (±2min)", "{:.1%}", True),
    "occupancy_avg_pct": ("Avg Occupancy %", "{:.1f}%", None),
    "occupancy_max_pct": ("Max Occupancy %", "{:.1f}%", False),
    "crowding_share": ("Crowding Share", "{:.1%}", False),
    "critical_crowding_share": ("Critical Crowding %", "{:.1%}", False),
    "underutilized_share": ("Underutilized Share", "{:.1%}", False),
    "avg_scheduled_travel_min": ("Scheduled Travel (min)", "{:.1f}", None),
    "avg_actual_travel_min": ("Actual Travel (min)", "{:.1f}", False),
    "avg_headway_min": ("Avg Headway (min)", "{:.1f}", None),
    "headway_std_min": ("Headway Std Dev (min)", "{:.1f}", False),
    "headway_cv": ("Headway CV", "{:.3f}", False),
    "bunching_share": ("Bunching Share", "{:.1%}", False),
    "gapping_share": ("Gapping Share", "{:.1%}", False),
    "severe_critical_share": ("Severe+Critical Delay %", "{:.1%}", False),
    "route_score": ("Route Score (0-100)", "{:.1f}", True),
    "route_rank": ("Route Rank", "{:.0f}", False),
    "route_class": ("Classification", "{}", None),
    "length_km": ("Route Length (km)", "{:.1f}", None),
    "category": ("Category", "{}", None),
}


def metrics_of(groups: Sequence[str] | None, columns: Sequence[str]) -> list[str]:
    """Metrics of the named groups (any spelling of a group name), those the frame has; all metrics if none match."""
    keys = [g.strip().lower().replace(" ", "_").replace("-", "_") for g in groups or ()]
    picked = [m for k in dict.fromkeys(keys) for m in METRIC_GROUPS.get(k, ())]
    picked = [m for m in dict.fromkeys(picked) if m in columns]
    return picked or [m for m in METRIC_SPECS if m in columns]


def _selected(df: DataFrame, ids: DataFrame | Sequence | None, key: str) -> DataFrame:
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids, key, "left_semi")
    return df.where(F.col(key).isin(*ids)) if len(ids) else df


def compare(
    df: DataFrame, ids: DataFrame | Sequence | None = None, groups: Sequence[str] | None = None, key: str = "route_id"
) -> DataFrame:
    """Chosen entities x numeric metrics in long form."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")]
    metrics = [m for m in metrics_of(groups, df.columns) if m in numeric]
    chosen = _selected(df, ids, key).select(key, *[F.col(m).cast("double").alias(m) for m in metrics])
    return chosen.unpivot([key], metrics, "metric", "value")


def transposed(long: DataFrame, key: str, prefix: str, always: Sequence = (), limit: int = 1_000) -> DataFrame:
    """One row per metric and one column per compared entity, in the order of the ids; more than ``limit`` are refused.

    Ids in ``always`` have a column, of nulls, also where they are not compared.
    """
    ids = [r[0] for r in long.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).limit(limit + 1).collect()]
    if len(ids) > limit:
        raise ValueError(f"more than {limit} entities to compare: select fewer")
    ids = sorted({*ids, *always})
    if not ids:
        return long.select("metric").distinct()
    return long.groupBy("metric").agg(*[F.max(F.when(F.col(key) == F.lit(i), F.col("value"))).alias(f"{prefix}{i}") for i in ids])


def median_differences(long: DataFrame, key: str = "route_id", digits: int | None = None) -> DataFrame:
    """Difference of every value from the selection's median of its metric (metrics with at least two values)."""
    have = long.where(F.col("value").isNotNull())
    n = have.groupBy("metric").agg(F.count(F.lit(1)).alias("_n"))
    med = exact_quantiles(have, ["metric"], "value", {"median": 0.5}).join(n.where("_n >= 2"), "metric", "left_semi")
    out = have.join(med, "metric")
    return out.withColumn("difference", X.rounded(F.col("value") - F.col("median"), digits))


def detailed(layer: Mapping[str, DataFrame], ids: DataFrame | Sequence | None = None) -> DataFrame:
    """Route scorecard with counts from the other analytics tables; each table is read once for all routes."""
    base = _selected(layer["route_metrics"], ids, "route_id").select(
        "route_id", "route_score", "passengers", "avg_delay_min", "on_time_share", "occupancy_avg_pct"
    )
    crowd = layer["overcrowding_events"].groupBy("route_id").agg(
        F.count(F.lit(1)).alias("crowding_events"), F.count_distinct("date").alias("persistent_crowding_days")
    )
    bunch = layer["bunching_events"].groupBy("route_id").agg(F.count(F.lit(1)).alias("bunching_events"))
    quality = layer["quality_days"].groupBy("route_id").agg(
        F.avg("quality_score").alias("avg_quality_score"), F.max_by("status", "date").alias("reliability_status")
    )
    demand = layer["daily_demand"].groupBy("route_id").agg(
        F.avg("passengers").alias("avg_daily_passengers"), F.max("passengers").cast("double").alias("peak_daily_passengers")
    )
    stops = route_stop_pairs(layer).groupBy("route_id").agg(
        X.count_if(F.col("is_bottleneck")).alias("bottleneck_stops"), F.count(F.lit(1)).alias("total_stops")
    )
    out = base
    for part in (crowd, bunch, quality, demand, stops):
        out = out.join(part, "route_id", "left")
    zero = F.lit(0).cast("long")
    counts = ("crowding_events", "persistent_crowding_days", "bunching_events", "bottleneck_stops", "total_stops")
    means = ("avg_daily_passengers", "peak_daily_passengers")
    return out.withColumns(
        {**{c: F.coalesce(c, zero) for c in counts}, **{c: F.coalesce(c, X.dbl(0.0)) for c in means}}
    )


def route_stop_pairs(layer: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct (route, stop) pairs with the stop's figures."""
    pairs = layer["stop_facts"].select("route_id", "stop_id").distinct()
    return pairs.join(layer["stop_metrics"].select("stop_id", "is_bottleneck", "boardings"), "stop_id", "left")


def comparison_summary(frame: DataFrame) -> DataFrame:
    return frame.agg(
        F.count(F.lit(1)).alias("routes_compared"),
        F.avg("route_score").alias("avg_route_score"),
        F.sum("passengers").alias("total_passengers"),
        F.avg("avg_delay_min").alias("avg_delay_min"),
        (F.avg("on_time_share") * 100).alias("avg_on_time_pct"),
        F.avg("occupancy_avg_pct").alias("avg_occupancy_pct"),
        F.sum("crowding_events").alias("total_crowding_events"),
        F.sum("bunching_events").alias("total_bunching_events"),
    )


def rank(df: DataFrame, metric: str, ascending: bool = False, n: int = 10, key: str = "route_id") -> DataFrame:
    """Top or bottom n entities by a metric."""
    if metric not in df.columns:
        raise ValueError(f"Metric {metric} not found")
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(order, key).limit(n)


def profiles(layer: Mapping[str, DataFrame], ids: DataFrame | Sequence | None = None, top: int = 5) -> DataFrame:
    """Full profile per route: the detailed comparison plus top stops, severity split, day states and demand trend."""
    base = detailed(layer, ids)
    pairs = route_stop_pairs(layer)
    place = F.row_number().over(W.partitionBy("route_id").orderBy(F.col("boardings").desc_nulls_last(), "stop_id"))
    few = pairs.withColumn("_rn", place).where(F.col("_rn") <= top)
    top_stops = few.groupBy("route_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", "stop_id"))), lambda r: r["stop_id"].cast("string")), ", "
        ).alias("top_boarding_stops")
    )
    crowd = layer["overcrowding_events"].groupBy("route_id").agg(
        X.count_if(F.col("severity") == "critical").alias("critical_events"),
        X.count_if(F.col("severity") == "high").alias("high_events"),
        F.array_join(F.array_sort(F.collect_set("time_band")), ", ").alias("peak_bands"),
    )
    bunch = layer["bunching_events"].groupBy("route_id").agg(F.count_distinct("date").alias("bunching_days"))
    days = layer["quality_days"].groupBy("route_id").agg(
        X.count_if(F.col("status") == "degraded").alias("degraded_days"),
        X.count_if(F.col("status") == "critical").alias("critical_days"),
    )
    # the last seven days of each route; fewer than seven give no trend
    last = layer["daily_demand"].withColumn("_rn", F.row_number().over(W.partitionBy("route_id").orderBy(F.col("date").desc())))
    trend = last.where(F.col("_rn") <= 7).groupBy("route_id").agg(
        F.when(F.count(F.lit(1)) == 7, F.avg("passengers")).alias("trend_7d")
    )
    out = base
    for part in (top_stops, crowd, bunch, days, trend):
        out = out.join(part, "route_id", "left")
    return out


def kpis(layer: Mapping[str, DataFrame]) -> DataFrame:
    """The executive row: thirteen figures, each a scalar aggregate of its own table."""
    daily = layer["daily_demand"].groupBy("date").agg(F.sum("passengers").alias("_p"))
    stops, alerts = layer["stop_metrics"], layer["alerts"].where("status = 'new'")

    def one(df: DataFrame, agg: Column) -> Column:
        return df.agg(agg).scalar()

    count = F.count(F.lit(1))
    return layer["route_metrics"].agg(
        count.alias("total_routes"),
        F.avg("avg_delay_min").alias("avg_delay_min"),
        F.avg("occupancy_avg_pct").alias("avg_occupancy_pct"),
        (F.avg("on_time_share") * 100).alias("on_time_pct"),
        F.coalesce(X.count_if(F.col("underutilized_share") > 0.5), F.lit(0)).alias("underutilized_routes"),
        F.avg("route_score").alias("route_score_avg"),
    ).select(
        "*",
        one(stops, F.count_distinct("stop_id")).alias("active_stops"),
        F.coalesce(one(daily, F.avg("_p")), X.dbl(0.0)).alias("total_passengers_daily"),
        one(layer["overcrowding_events"], count).alias("overcrowding_events"),
        one(layer["persistent_overcrowding"], count).alias("persistent_overcrowding_routes"),
        one(alerts, count).alias("active_alerts"),
        one(alerts, F.coalesce(X.count_if(F.col("severity") == "critical"), F.lit(0))).alias("critical_alerts"),
        one(stops, F.coalesce(X.count_if(F.col("is_bottleneck")), F.lit(0))).alias("bottleneck_stops"),
    )


def filter_in(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose column is in the list; an absent column or empty list filters nothing."""
    return df.where(F.col(column).isin(*values)) if values and column in df.columns else df


def filter_dates(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    if column not in df.columns:
        return df
    day = F.col(column).cast("date") if dict(df.dtypes)[column] != "string" else F.to_date(F.try_to_timestamp(F.col(column)))
    out = df
    if start:
        out = out.where(day >= F.lit(start).cast("date"))
    if end:
        out = out.where(day <= F.lit(end).cast("date"))
    return out


def filter_scores(
    df: DataFrame, lo: float, hi: float, categories: Sequence[str] = (), classes: Sequence[str] = (), score: str = "route_score"
) -> DataFrame:
    out = df.where(F.col(score).between(lo, hi))
    return filter_in(filter_in(out, "category", categories), "route_class", classes)


class DataAccess:
    """Filtered accessors over a persisted analytics folder (one Parquet dataset per table)."""

    def __init__(self, spark, folder: str):
        self._spark, self._folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def route_metrics(self, route_ids: Sequence | None = None) -> DataFrame:
        return filter_in(self.table("route_metrics"), "route_id", route_ids)

    def stop_metrics(self, stop_ids: Sequence | None = None) -> DataFrame:
        return filter_in(self.table("stop_metrics"), "stop_id", stop_ids)

    def daily_demand(self, route_ids: Sequence | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        return filter_dates(filter_in(self.table("daily_demand"), "route_id", route_ids), "date", start, end)

    def overcrowding_events(self, route_ids: Sequence | None = None, severity: Sequence[str] | None = None) -> DataFrame:
        return filter_in(filter_in(self.table("overcrowding_events"), "route_id", route_ids), "severity", severity)

    def alerts(self, status: Sequence[str] | None = None, severity: Sequence[str] | None = None) -> DataFrame:
        return filter_in(filter_in(self.table("alerts"), "status", status), "severity", severity)

    def recommendations(self, priority: Sequence[str] | None = None, category: Sequence[str] | None = None) -> DataFrame:
        return filter_in(filter_in(self.table("recommendations"), "priority", priority), "category", category)
