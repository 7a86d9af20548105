"""Registry of named queries: a Spark callable over a data folder, and SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.plans.oracle import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that results compare equal across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(c.cast("string").alias(f.name) if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise KeyError(name)

        def build(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # clocks are compared as microseconds since the epoch
            return portable(fn(spark, root))

        REGISTRY[name] = Query(name, build, with_views(sql) if sql else None)
        return fn

    return register


def load() -> dict[str, Query]:
    from headwise.plans import (  # noqa: F401
        analytics_queries,
        decision_queries,
        feature_queries,
        join_queries,
        layered_queries,
        model_queries,
        quality_queries,
        rollup_queries,
        scalar_queries,
        storage_queries,
    )

    return REGISTRY
