"""Exact percentiles that never hold a whole group in one task.

Spark's ``percentile`` keeps one hash map of distinct values per group in a single task, so a group with a third of
all rows does not fit. Here a mergeable sketch of each large group first brackets the wanted rank; only values inside the
narrow bracket are then counted and ordered. Small groups are ordered whole, in one shuffle of their rows. The answer is exact (linear interpolation), the bracket only bounds the work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise.functions.nullsafe import join_groups
from headwise.functions.scalars import col, dbl
from headwise.session import materialise

ACCURACY = 10_000
SMALL_GROUP = 16_384


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Mapping[str, float],
    accuracy: int = ACCURACY,
    small_group: int = SMALL_GROUP,
    aggs: Sequence[Column] = (),
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (name -> probability). Null values are ignored.

    ``aggs`` are further aggregates of the same groups, computed in the first pass. ``keep(df, name)`` may persist the
    one-row-per-group result of that pass, which the later passes and the final join would otherwise compute again.

    The first pass sizes the groups. Groups of at most ``small_group`` rows are ordered as they are, in one shuffle of key and
    value: a sketch for each of many small groups would be larger than their rows. The larger groups (at most one for
    ``small_group`` rows) are written with their key, then sketched (bounded state, merged map-side) for a value bracket of
    +-(1/small_group + 3/accuracy) in rank around each probability. Then values are counted: everything below the bracket
    collapses to one counter per map task, everything above is dropped, and the values inside are counted by (key, value)
    before any ordering. The sizes and the list of large groups are written when the operator is called, so that Spark
    knows how small that list is before it plans the joins with it. A null key is a group.
    """
    keys = list(keys)
    rows = df.select(*keys, col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        summary = rows.agg(*_size(), _sketch(probs, accuracy, small_group))
        packed = summary.select(F.struct("_n", *_brackets(probs, accuracy, small_group)).alias("_s")).scalar()
        return _bracketed(rows.select("_v", packed.alias("_s")).select("_v", "_s.*"), [], probs)

    grouped = df.withColumn("_v", col(value).cast("double")).groupBy(*keys).agg(*aggs, *_size())
    base = (keep or materialise)(grouped, "group_sizes")
    extra = [c for c in base.columns if c not in {*keys, "_n", "_min", "_max"}]
    few, many = F.col("_n") <= small_group, F.col("_n") > small_group
    found = base.agg(F.coalesce(F.max(few), F.lit(False)).alias("few"), F.coalesce(F.max(many), F.lit(False)).alias("many")).first()
    parts = []
    if found.many:
        large = materialise(base.where(many).select(*keys, "_n", "_min", "_max"), "large_groups")
        those = materialise(join_groups(rows, large.select(*keys), keys, "left_semi"), "large_group_rows")
        cuts = materialise(join_groups(large, those.groupBy(*keys).agg(_sketch(probs, accuracy, small_group)), keys), "large_group_cuts")
        joined = join_groups(those, cuts.select(*keys, "_n", *_brackets(probs, accuracy, small_group)), keys)
        parts.append(_bracketed(joined, keys, probs))
    if found.few or not parts:
        rest = join_groups(rows, large.select(*keys), keys, "left_anti") if parts else rows
        parts.append(_ordered(rest, keys, probs))
    result = reduce(DataFrame.unionByName, parts)
    return join_groups(base.select(*keys, *extra), result, keys, "left") if extra else result


def _size() -> list[Column]:
    return [F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]


def _width(accuracy: int, small_group: int) -> float:
    return 1.0 / small_group + 3.0 / accuracy


def _sketch(probs: Mapping[str, float], accuracy: int, small_group: int, value: str = "_v") -> Column:
    eps, cuts = _width(accuracy, small_group), []
    for p in probs.values():
        cuts += [max(p - eps, 0.0), min(p + eps, 1.0)]
    return F.percentile_approx(value, F.array(*[dbl(c) for c in cuts]), F.lit(accuracy)).alias("_cut")


def _brackets(probs: Mapping[str, float], accuracy: int, small_group: int) -> list[Column]:
    """Bounds of each probability's bracket from ``_n``, ``_min``, ``_max`` and the sketch's ``_cut``."""
    eps, out = _width(accuracy, small_group), []
    for i, p in enumerate(probs.values()):
        lo = F.col("_min") if p - eps <= 0.0 else F.col("_cut")[2 * i]
        hi = F.col("_max") if p + eps >= 1.0 else F.col("_cut")[2 * i + 1]
        lo, hi = (F.when(F.col("_n") <= small_group, F.col(m)).otherwise(c) for m, c in (("_min", lo), ("_max", hi)))
        out += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    return out


def _ordered(rows: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Percentiles of groups that are small enough to be ordered in one place each."""
    group = W.partitionBy(*keys)
    placed = rows.select(*keys, "_v", (F.row_number().over(group.orderBy("_v")) - 1).alias("_at"), F.count("_v").over(group).alias("_n"))
    at = {name: (F.col("_n") - 1) * dbl(p) for name, p in probs.items()}
    wanted = [f(pos) == F.col("_at") for pos in at.values() for f in (F.floor, F.ceil)]
    picks = []
    for i, pos in enumerate(at.values()):
        picks += [F.min(F.when(f(pos) == F.col("_at"), F.col("_v"))).alias(f"_{end}{i}") for end, f in (("a", F.floor), ("b", F.ceil))]
    ends = placed.where(reduce(or_, wanted)).groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    return ends.select(
        *keys,
        *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (pos - F.floor(pos))).alias(name) for i, (name, pos) in enumerate(at.items())],
    )


def _bracketed(joined: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Percentiles from rows that carry the size of their group and the bounds of its brackets."""
    names = list(probs)

    def slot(i: int) -> Column:
        return F.struct(F.lit(i).alias("_i"), F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v")).alias("_x"))

    if len(names) == 1:
        slots = joined.where(F.col("_v") <= F.col("_hi0")).select(*keys, "_n", slot(0).alias("_p"))
    else:
        each = F.array(*[F.when(F.col("_v") <= F.col(f"_hi{i}"), slot(i)) for i in range(len(names))])
        slots = joined.select(*keys, "_n", F.explode(each).alias("_p")).where(F.col("_p").isNotNull())
    counted = slots.select(*keys, "_n", "_p._i", "_p._x").groupBy(*keys, "_n", "_i", "_x").count()
    picked = _picked(counted, [*keys, "_i"], F.element_at(F.array(*[dbl(p) for p in probs.values()]), F.col("_i") + 1))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)])


def _picked(counted: DataFrame, keys: Sequence[str], prob: Column) -> DataFrame:
    """Keys and percentile ``_q`` from the counted values (``_x``) of each bracket; a null counts those below it."""
    # only bracket values of one group reach a window partition; the "below" counter sorts first as null
    upto = W.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_first())
    ranked = counted.withColumn("_cum", F.sum("count").over(upto.rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_pos", (F.col("_n") - 1) * prob)
    lower, upper = F.floor("_pos"), F.ceil("_pos")
    picked = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") > lower, F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_cum") > upper, F.col("_x"))).alias("_b"),
        F.max(F.when(F.col("_x").isNull(), F.col("_cum")).otherwise(0)).alias("_below"),
        F.first("_pos").alias("_pos"),
    )
    missed = (F.col("_below") > F.floor("_pos")) | F.col("_b").isNull()
    exact = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    )
    return picked.withColumn("_q", exact)


def exact_column_quantiles(
    df: DataFrame, columns: Sequence[str], p: float, accuracy: int = ACCURACY, small_group: int = SMALL_GROUP
) -> DataFrame:
    """The same percentile of several columns: ``column`` and ``q``, a row for each column that is not all null or NaN.

    Rows are read twice and stay rows: the first pass sizes and sketches every column, the second one counts, in each task,
    the values inside a column's bracket by value and all that lie below it as one.
    """
    columns, probs = list(columns), {"q": p}
    cells = [col(c).cast("double") for c in columns]
    values = df.select(*[F.when(~F.isnan(v), v).alias(f"_v{i}") for i, v in enumerate(cells)])
    sized = values.agg(*[
        F.struct(
            F.count(f"_v{i}").alias("_n"), F.min(f"_v{i}").alias("_min"), F.max(f"_v{i}").alias("_max"),
            _sketch(probs, accuracy, small_group, f"_v{i}"),
        ).alias(f"_s{i}")
        for i in range(len(columns))
    ])
    bounds = sized.select(F.posexplode(F.array(*[F.col(f"_s{i}") for i in range(len(columns))])).alias("_i", "_s")).select("_i", "_s.*")
    found = {r["_i"]: r for r in bounds.select("_i", "_n", *_brackets(probs, accuracy, small_group)).where("_n > 0").collect()}  # a row a column
    inside = []
    for i, r in found.items():
        v, n = F.col(f"_v{i}"), F.lit(r["_n"]).cast("long")
        seen = F.struct(F.lit(i).alias("_i"), n.alias("_n"), v.alias("_x"))
        inside.append((v, r, seen))
    if not inside:
        return df.sparkSession.createDataFrame([], "column string, q double")
    within = [F.when((v >= dbl(r["_lo0"])) & (v <= dbl(r["_hi0"])), seen) for v, r, seen in inside]
    shown = values.select(F.explode(F.array_compact(F.array(*within))).alias("_c")).select("_c.*")
    below = values.agg(*[F.count(F.when(v < dbl(r["_lo0"]), v)).alias(f"_b{r['_i']}") for v, r, _ in inside]).first()
    lower = [(i, r["_n"], None, below[f"_b{i}"]) for i, r in found.items() if below[f"_b{i}"]]
    counted = shown.groupBy("_i", "_n", "_x").count()
    counted = counted.unionByName(df.sparkSession.createDataFrame(lower, "_i int, _n long, _x double, count long"))
    return _picked(counted, ["_i"], dbl(p)).select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_i") + 1).alias("column"), F.col("_q").alias("q"))


def exact_quantile_scalar(df: DataFrame, value: Column | str, p: float) -> Column:
    """A whole-frame percentile as a scalar subquery, usable inside any expression."""
    return exact_quantiles(df, [], value, {"q": p}).scalar()


def tail_z(p: float) -> float:
    """Standard-normal quantile by bisection on the error function (used for mean + z*std proxies)."""
    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
