"""The network's baseline row: one value of each headline metric."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.functions import scalars as X


def baseline(layer: Mapping[str, DataFrame]) -> DataFrame:
    """Current figures of the network in one row."""
    daily = layer["daily_demand"].groupBy("date").agg(F.sum("passengers").alias("p"), F.sum("revenue").alias("r"))

    def one(df: DataFrame, agg: Column) -> Column:
        return df.agg(agg).scalar()

    return layer["route_metrics"].agg(
        F.count(F.lit(1)).cast("double").alias("total_routes"),
        F.avg("avg_delay_min").alias("avg_delay_min"),
        F.avg("occupancy_avg_pct").alias("avg_occupancy_avg_pct"),
        F.avg("occupancy_max_pct").alias("avg_occupancy_max_pct"),
        F.avg("on_time_share").alias("on_time_share"),
        F.avg("bunching_share").alias("avg_bunching_share"),
        F.avg("avg_headway_min").alias("avg_headway_min"),
        X.count_if(F.col("underutilized_share") > 0.5).cast("double").alias("underutilized_routes"),
    ).select(
        "*",
        one(daily, F.avg("p")).alias("total_passengers_daily"),
        one(daily, F.avg("r")).alias("avg_revenue_daily"),
        one(layer["overcrowding_events"], F.count(F.lit(1)).cast("double")).alias("overcrowding_events"),
        one(layer["stop_metrics"], X.count_if(F.col("is_bottleneck")).cast("double")).alias("bottleneck_stops"),
    )
