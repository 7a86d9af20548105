"""As-of joins: the last row of another table at or before each row, in groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise.functions.nullsafe import join_groups
from headwise.functions.scalars import col
from headwise.functions.scans import CHUNK, equi_depth


def last_match(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    values: Mapping[str, Column | str],
    strict: bool = False,
    tolerance: Column | float | None = None,
) -> DataFrame:
    """Rows of ``left`` with the ``values`` of the last row of ``right`` of the same keys at or before them.

    ``strict`` takes only earlier rows, ``tolerance`` only those at most so far back; rows without a match get nulls, as do
    rows without a place in the order. Of rows of ``right`` at one place the one with the largest values counts, in the
    order in which they are named. A null key is a key like any other.

    Both tables are cut into ranges of about equal numbers of rows along (keys, place), so a hot key is spread over many
    tasks. The last match is found inside each range, and one small row for each key of a range carries it on.
    """
    keys = list(keys)
    found = F.struct(col(right_at).alias("_at"), *[col(v).alias(n) for n, v in values.items()])
    places = ("_at", "_side", "_found")
    rows = left.select(*keys, col(left_at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    events = right.where(col(right_at).isNotNull()).select(*keys, col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), found.alias("_found"))
    tied = rows.unionByName(events, allowMissingColumns=True).withColumn("_tie", F.xxhash64("_row", "_found"))
    both = equi_depth(tied, [*keys, "_at", "_side", "_tie"])
    totals = both.groupBy(*keys, CHUNK).agg(F.max("_found").alias("_last"))  # the place comes first in the struct
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, F.max("_last").over(earlier).alias("_carry"))
    inside = W.partitionBy(*keys, CHUNK).orderBy(*places).rowsBetween(W.unboundedPreceding, 0)
    joined = join_groups(both.withColumn("_inside", F.max("_found").over(inside)).where(F.col("_row").isNotNull()), carry, [*keys, CHUNK], "left")
    match = F.greatest("_inside", "_carry")  # rows of one place may lie in two ranges
    near = F.col("_at").isNotNull()
    if tolerance is not None:
        near = near & (F.col("_at") - match["_at"] <= tolerance)
    return joined.select("_row.*", *[F.when(near, match[n]).alias(n) for n in values])
