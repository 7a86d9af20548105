"""Joins in which null keys match null keys, as they do in grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to the table of their groups; a null key finds the group of nulls."""
    other = {k: f"_of_{k}" for k in keys}
    right = groups.withColumnsRenamed(other)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{o}`")) for k, o in other.items()])
    return df.join(right, same, how).drop(*other.values())
