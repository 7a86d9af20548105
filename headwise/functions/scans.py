"""Ordered scans over groups too large for one task.

A plain window sends a whole partition-by group to one task. These operators cut each group into ordered chunks (for
example one per hour), scan inside the chunks in parallel, and carry one small row per chunk across chunk borders.
``chunk`` must be a function of the row that never decreases along ``order``; it decides the largest task. A null key
is a group of its own, and a null chunk comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise.functions.nullsafe import join_groups
from headwise.functions.scalars import col
from headwise.session import materialise

CHUNK = "_chunk"


def micros_chunk(us: Column | str, minutes: int = 60) -> Column:
    """Chunk number of a microsecond clock value."""
    return F.floor(col(us) / F.lit(minutes * 60_000_000)).cast("long")


def equi_depth(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The frame with a chunk column (``CHUNK``) of about equally many rows each, numbered along ``order``.

    Rows are dealt into ranges of (keys, order, tie-break) by a sample, as a sort would deal them, so neither a busy hour nor
    a key with most of the rows makes a large chunk; ``order`` should end with columns that break ties. The number of
    ranges is the session's shuffle partitions unless given. The result is written, since where a range ends is known to
    that one pass only; pass ``F.col(CHUNK)`` as the chunk of a scan over it.
    """
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *order).withColumn(CHUNK, F.spark_partition_id()), "ranges")


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Mapping[str, Column | str],
    source: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Value of the preceding row of the group (lag 1) under each name of ``values``.

    ``source`` may name a cheaper frame with the same rows for the chunk table. ``keep(df, name)`` may write that table, so
    that Spark knows how small it is before it plans the join with the rows.
    """
    keys, order = list(keys), list(order)
    packed = F.struct(*[col(v).alias(n) for n, v in values.items()])
    base = df.withColumn(CHUNK, chunk)
    ends = base if source is None else source.withColumn(CHUNK, chunk)
    last = ends.groupBy(*keys, CHUNK).agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carry = last.select(
        *keys, CHUNK, F.lag("_last").over(W.partitionBy(*keys).orderBy(CHUNK)).alias("_carry")
    )
    carry = keep(carry, "chunk_carry") if keep else carry
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order)
    joined = join_groups(base, carry, [*keys, CHUNK], "left")
    joined = joined.withColumn("_prev", F.coalesce(F.lag(packed).over(inside), F.col("_carry")))
    return joined.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in values])


def chunk_carries(
    source: DataFrame,
    keys: Sequence[str],
    levels: Mapping[str, Sequence[str]],
    chunk: Column,
    sums: Mapping[str, Column],
    maxes: Mapping[str, Column],
) -> DataFrame:
    """For each group and chunk, the sums and maxima over the earlier chunks at every level: ``_c_<level><name>``."""
    keys = list(keys)
    extra = sorted({c for cols in levels.values() for c in cols} - set(keys))
    totals = source.withColumn(CHUNK, chunk).groupBy(*keys, *extra, CHUNK).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxes.items()],
    )
    carries = []
    for prefix, cols in levels.items():
        earlier = W.partitionBy(*cols).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
        carries += [F.sum(f"_t_{n}").over(earlier).alias(f"_c_{prefix}{n}") for n in sums]
        carries += [F.max(f"_t_{n}").over(earlier).alias(f"_c_{prefix}{n}") for n in maxes]
    return totals.select(*keys, CHUNK, *carries)


def prior_levels(
    df: DataFrame,
    keys: Sequence[str],
    levels: Mapping[str, Sequence[str]],
    order: Sequence[str],
    chunk: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    inclusive: bool = False,
    source: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Running sums and maxima over earlier rows, at several grouping levels from one pass over the rows.

    ``levels`` maps a prefix to its group keys: ``keys`` plus columns that are constant inside a chunk (the date of an
    hourly chunk, say). All levels share the scan inside the chunks and differ only in how the small chunk table is
    accumulated, so the rows are shuffled once. ``source`` may name a cheaper frame with the same rows for the chunk
    table, and ``keep(df, name)`` may write that table, so that its size is known before the join is planned: rows that lie
    by their chunk already then stay where they are. Sums over no rows are 0, maxima over no rows are null.
    """
    keys, order = list(keys), list(order)
    sums, maxes = dict(sums or {}), dict(maxes or {})
    base = df.withColumn(CHUNK, chunk)
    carry = chunk_carries(df if source is None else source, keys, levels, chunk, sums, maxes)
    carry = keep(carry, "chunk_carry") if keep else carry
    end = 0 if inclusive else -1
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    joined = join_groups(base, carry, [*keys, CHUNK], "left")
    joined = joined.select(
        "*",
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()],
        *[F.max(c).over(inside).alias(f"_i_{n}") for n, c in maxes.items()],
    )
    outs = []
    for prefix in levels:
        outs += [
            (F.col(f"_i_{n}") + F.coalesce(F.col(f"_c_{prefix}{n}"), F.lit(0))).alias(f"{prefix}{n}") for n in sums
        ]
        outs += [F.greatest(f"_i_{n}", f"_c_{prefix}{n}").alias(f"{prefix}{n}") for n in maxes]
    return joined.select(*df.columns, *outs)


def tails_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """For each group and chunk of ``rows`` (``CHUNK``) the last ``n`` rows of the group in earlier chunks, under that chunk's number.

    Put before the rows of a chunk, they let a window inside the chunk look ``n`` rows back across its border.
    """
    keys, names = list(keys), rows.columns
    latest = [F.col(c).desc() for c in order]
    ends = rows.withColumn("_back", F.row_number().over(W.partitionBy(*keys, CHUNK).orderBy(*latest))).where(F.col("_back") <= n)
    ends = keep(ends.drop("_back"), "chunk_ends")  # at most n rows a group and chunk
    placed = keep(ends.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(CHUNK, *order))), "chunk_ends_placed")
    first = placed.groupBy(*keys, CHUNK).agg(F.min("_at").alias("_first"))
    wanted = first.withColumn("_at", F.explode(F.sequence(F.col("_first") - n, F.col("_first") - 1))).drop("_first")
    wanted = keep(wanted.where("_at > 0").withColumnRenamed(CHUNK, "_for"), "chunk_ends_wanted")
    found = join_groups(wanted, placed, [*keys, "_at"]).drop(CHUNK)
    return found.withColumnRenamed("_for", CHUNK).select(*names)


HEAVY_ROWS, HEAVY_MOST, BUCKETS = 50_000, 256, 65_536


def heavy_buckets(df: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> list[int]:
    """Hash buckets of ``key`` with more than ``heavy_rows`` rows, at most the ``HEAVY_MOST`` largest (so that no other holds a larger share of
    the rows than one in that many). A key with so many rows lies in one of them; keys that share its bucket count as heavy too."""
    sizes = df.groupBy(_bucket(key).alias("_b")).count().where(F.col("count") > heavy_rows)
    return [r["_b"] for r in sizes.orderBy(F.col("count").desc(), "_b").limit(HEAVY_MOST).collect()]


def is_heavy(key: str, buckets: Sequence[int]) -> Column:
    return _bucket(key).isin(*buckets)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def prior_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    inclusive: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Running sums and maxima of each group over earlier rows only (or up to the row when ``inclusive``)."""
    return prior_levels(df, keys, {"": keys}, order, chunk, sums, maxes, inclusive, source)


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str, source: DataFrame | None = None
) -> DataFrame:
    """0-based position of each row in its group."""
    return prior_aggregates(df, keys, order, chunk, sums={name: F.lit(1)}, source=source)


def global_rank(df: DataFrame, order: Sequence[Column], chunk: Column, name: str) -> DataFrame:
    """1-based rank over the whole frame without collecting it in one task.

    ``chunk`` grows along ``order`` and has a bounded number of values; only one counter per chunk is ordered globally.
    """
    base = df.withColumn(CHUNK, chunk)
    before = base.groupBy(CHUNK).count()
    before = before.select(
        CHUNK,
        F.coalesce(
            F.sum("count").over(W.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = W.partitionBy(CHUNK).orderBy(*order)
    ranked = join_groups(base, before, [CHUNK]).withColumn(name, F.col("_before") + F.row_number().over(inside))
    return ranked.select(*df.columns, name)


def trailing_means(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: str,
    windows: Mapping[str, int],
    block_rows: int = 1_000_000,
    source: DataFrame | None = None,
) -> DataFrame:
    """Mean of ``value`` over the previous N rows of the group, current row excluded, for each name -> N.

    Rows get their position first; positions are cut into blocks of ``block_rows`` and each block also receives the
    last N rows of the block before it, so every window partition is bounded whatever the group's size.
    """
    keys = list(keys)
    halo = max(windows.values())
    placed = row_index(df, keys, order, chunk, "_pos", source)
    block = F.floor(F.col("_pos") / block_rows)
    near_end = F.col("_pos") % block_rows >= block_rows - halo
    blocks = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    spread = placed.withColumn("_block", F.explode(blocks))
    w = W.partitionBy(*keys, "_block").orderBy("_pos")
    out = spread.select(
        *df.columns,
        "_block",
        "_pos",
        *[F.avg(value).over(w.rowsBetween(-n, -1)).alias(name) for name, n in windows.items()],
    )
    own = F.col("_block") == F.floor(F.col("_pos") / block_rows)
    return out.where(own).select(*df.columns, *windows)


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Group statistics on every row, as aggregate plus join.

    A window without order would hold the whole group in one task; here the aggregate combines map-side and the
    adaptive join splits a hot key.
    """
    keys = list(keys)
    return join_groups(df, df.groupBy(*keys).agg(*aggs), keys, "left")
