"""Enrichment and matching joins. No join is hinted: Spark broadcasts a side only below its measured size limit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.functions import scalars as X


def add_context(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join that adds only columns the left side does not have yet."""
    on = [on] if isinstance(on, str) else list(on)
    keep = [c for c in right.columns if c in on or c not in left.columns]
    return left.join(right.select(*keep), on, "left")


GAP = "has_gap"


def gap_flag(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """The columns to keep, and whether any column of the row is null."""
    return df.select(*sorted(keep), _any_null(df).alias(GAP))


def add_gaps(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join of two flagged frames into one flag. A row without a match lacks the whole right side, which is a gap."""
    other = right.withColumnRenamed(GAP, "_other")
    gap = F.col(GAP) | F.coalesce("_other", F.lit(True))
    return left.join(other, on, "left").select(*[c for c in left.columns if c != GAP], gap.alias(GAP))


def join_diagnostics(source: DataFrame, merged: DataFrame, keys: Sequence[str], gap: str | None = None) -> DataFrame:
    """One row: source rows, merged rows, rows beyond the first per key, rows with a missing value.

    ``gap`` names a flag of the merged rows that tells of a missing value, where their other columns were left out.
    """
    n_src = source.agg(F.count(F.lit(1))).scalar()
    groups = merged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        X.count_if(F.col(gap) if gap else _any_null(merged)).alias("_nulls"),
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("merged_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicated_keys"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("rows_with_missing_context"),
    ).select(n_src.alias("source_rows"), "merged_rows", "duplicated_keys", "rows_with_missing_context")


def _any_null(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in df.columns:
        out = out | F.col(c).isNull()
    return out


def check_no_multiply(source: DataFrame, merged: DataFrame, keys: Sequence[str]) -> dict:
    """Fails when a join changed the row count; returns the diagnostics of a good one."""
    row = join_diagnostics(source, merged, keys).first().asDict()
    if row["source_rows"] != row["merged_rows"]:
        raise ValueError(
            f"join changed the row count: source {row['source_rows']}, merged {row['merged_rows']} on {list(keys)}"
        )
    return row


def trip_facts(trips: DataFrame, routes: DataFrame, vehicles: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Trips with route, vehicle and calendar attributes (unmatched keys keep their trip)."""
    r = routes.select("route_id", F.col("category").alias("route_category"), F.col("length_km").alias("route_length_km"))
    v = vehicles.select("vehicle_id", "vehicle_type", "capacity")
    out = trips.join(r, "route_id", "left").join(v, "vehicle_id", "left")
    return out if context is None else add_context(out, context, "trip_id")


def stop_facts(visits: DataFrame, trip_context: DataFrame, stops: DataFrame) -> DataFrame:
    out = add_context(visits, trip_context, "trip_id")
    return add_context(out, stops.select("stop_id", "stop_name", "zone"), "stop_id")


def passenger_flow(rides: DataFrame, trip_context: DataFrame, stops: DataFrame, board: str, alight: str) -> DataFrame:
    """Rides with trip context and the zone of both ends.

    The zones come first: the context, the widest of the three, is then moved by no later join.
    """
    context = trip_context.select(*[c for c in trip_context.columns if c == "trip_id" or c not in rides.columns])
    out = rides
    for end, name in ((board, "boarding_zone"), (alight, "alighting_zone")):
        zone = stops.select(F.col("stop_id").alias(end), F.col("zone").alias(name))
        out = out.join(zone, end, "left")
    keys = [alight, board, "trip_id"]
    own = [c for c in rides.columns if c not in keys]
    added = [c for c in context.columns if c != "trip_id"]
    return out.join(context, "trip_id", "left").select(*keys, *own, *added, "boarding_zone", "alighting_zone")


def route_zones(route_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Distinct zones served by each route."""
    return route_stops.join(stops, "stop_id").select("route_id", "zone").distinct()


def event_multiplier(df: DataFrame, zones: DataFrame, events: DataFrame) -> DataFrame:
    """Strongest multiplier of the events in the route's zones that day, 1 when there is none."""
    best = (
        zones.join(events.select("zone", "date", "demand_multiplier"), "zone")
        .groupBy("route_id", "date")
        .agg(F.max("demand_multiplier").alias("event_multiplier"))
    )
    return df.join(best, ["route_id", "date"], "left").withColumn(
        "event_multiplier", F.coalesce("event_multiplier", X.dbl(1.0))
    )


def zone_balance(rides: DataFrame) -> DataFrame:
    """Inflow, outflow and net per zone; a zone seen on one side only counts 0 on the other."""
    outflow = rides.groupBy(F.col("boarding_zone").alias("zone")).agg(F.count(F.lit(1)).alias("outflow"))
    inflow = rides.groupBy(F.col("alighting_zone").alias("zone")).agg(F.count(F.lit(1)).alias("inflow"))
    zero = F.lit(0).cast("long")
    both = outflow.join(inflow, "zone", "outer").withColumns(
        {"outflow": F.coalesce("outflow", zero), "inflow": F.coalesce("inflow", zero)}
    )
    return both.withColumn("net", F.col("inflow") - F.col("outflow"))


def only_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(listed, on, "left_semi")


def not_covered(df: DataFrame, covered: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(covered, on, "left_anti")


def model_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two outputs side by side on their key, with the difference."""
    a = left.select(*keys, F.col(value).alias(f"{value}_a"))
    b = right.select(*keys, F.col(value).alias(f"{value}_b"))
    diff = F.col(f"{value}_a") - F.col(f"{value}_b")
    return a.join(b, list(keys), "left").withColumn("difference", diff)
