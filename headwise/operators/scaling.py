"""Whole-frame scaling with scalar bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.functions.scalars import dbl


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """Scale to 0..1 by the frame's own bounds; a constant column gives 0.5."""
    bounds = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    out = df.withColumn("_b", bounds)
    span = F.col("_b.hi") - F.col("_b.lo")
    scaled = F.when(span > 0, F.try_divide(F.col(value) - F.col("_b.lo"), span)).otherwise(dbl(0.5))
    return out.withColumn(name, F.when(F.col(value).isNotNull(), scaled)).drop("_b")
