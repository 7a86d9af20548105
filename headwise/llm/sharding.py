"""Uniform sharding with exact sizes, by a hypergeometric communication matrix.

The rows lie in partitions of known sizes. For each partition the numbers of rows that go to each bin are drawn from the
multivariate hypergeometric law, given what the bins still lack, which is how a uniform permutation of all rows would
deal them. Each partition then permutes its rows, deals them by those numbers, and each bin permutes what it got. Bins
are the fixed-size parts of shards, so that a large shard is still permuted by many tasks, and a slot is the bin's known
offset plus the place in the bin. Every permutation of the rows over the slots is equally likely.

Law ``rows``: sizes of shards differ by one row at most, whatever the rows hold; equal texts, ties, repeated rows and
nulls are rows like any others. An empty table gives no rows. Other columns, whatever their names, stay outside: the
table that moves holds the id, the size, the checksum and two random numbers.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import text_of, written

#: Bytes of a document besides its text.
OVERHEAD = 16


def bin_sizes(total: int, shards: int, rows_per_bin: int) -> list[tuple[int, int, int]]:
    """Shard, offset in the shard, and rows of each bin; sizes are as equal as whole numbers allow."""
    out = []
    for shard in range(shards):
        size = total // shards + (shard < total % shards)
        parts = max(1, -(-size // rows_per_bin))
        offset = 0
        for k in range(parts):
            rows = size // parts + (k < size % parts)
            out.append((shard, offset, rows))
            offset += rows
    return out


#: The random generator draws from populations below this size.
LIBRARY = 10**9


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among n of a population of any size, exactly.

    A large population takes each member with the chance n / (good + bad), which gives a uniform subset of its own size,
    and then a uniform subset of what is too much or too little, about the root of n, is taken out or added likewise.
    """
    if good + bad < LIBRARY:
        return int(draw.hypergeometric(good, bad, n))
    if n <= 32:
        found = 0
        for i in range(n):
            found += int(draw.integers(good + bad - i)) < good - found
        return found
    chance = n / (good + bad)
    x, y = int(draw.binomial(good, chance)), int(draw.binomial(bad, chance))
    if x + y > n:
        return x - hypergeometric(draw, x, y, x + y - n)
    return x + hypergeometric(draw, good - x, bad - y, n - x - y)


def multivariate(draw: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """How many of each color are among n: halves of the colors share out n until a library draw can take over."""
    if int(colors.sum()) < LIBRARY:
        return draw.multivariate_hypergeometric(colors, n, method="marginals")
    if len(colors) == 1:
        return np.array([n], dtype=np.int64)
    half = len(colors) // 2
    left, right = int(colors[:half].sum()), int(colors[half:].sum())
    of_left = hypergeometric(draw, left, right, n)
    return np.concatenate([multivariate(draw, colors[:half], of_left), multivariate(draw, colors[half:], n - of_left)])


def communication_matrix(sources: list[int], bins: list[int], seed: int) -> np.ndarray:
    """How many rows each source sends to each bin: row sums are the sources, column sums the bins."""
    draw, left = np.random.default_rng(seed), np.array(bins, dtype=np.int64)
    matrix = np.zeros((len(sources), len(bins)), dtype=np.int64)
    for i, rows in enumerate(sources):
        matrix[i] = multivariate(draw, left, rows)
        left -= matrix[i]
    return matrix


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 20, rows_per_bin: int = 500_000) -> DataFrame:
    """Shard and slot of every row, with the size and the CRC-32 of its text.

    The driver holds one number for each partition and bin, which depends on the layout, not on what the rows hold.
    """
    spark = df.sparkSession
    text = text_of(text_col).cast("binary")
    narrow = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.spark_partition_id().alias("source"),
        F.rand(seed).alias("first_draw"),
        F.rand(seed + 1).alias("second_draw"),
    )
    rows = written(narrow, "shard-rows")  # the draws are kept, so a task that runs again deals as before
    counted = [(r[0], r[1]) for r in rows.groupBy("source").count().orderBy("source").collect()]  # one row per partition
    bins = bin_sizes(sum(n for _, n in counted), shards, rows_per_bin)
    matrix = communication_matrix([n for _, n in counted], [n for _, _, n in bins], seed)
    dealt = [{"source": s, "ends": np.cumsum(row).tolist()} for (s, _), row in zip(counted, matrix, strict=True)]
    ends = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(dealt)), "array<struct<source:int,ends:array<bigint>>>")))
    offsets = spark.range(1).select(
        F.inline(
            F.from_json(
                F.lit(json.dumps([{"bin": i, "shard": s, "offset": o} for i, (s, o, _) in enumerate(bins)])),
                "array<struct<bin:int,shard:int,offset:bigint>>",
            )
        )
    )
    locally = Window.partitionBy("source").orderBy("first_draw", "second_draw", "doc_id")
    in_bin = Window.partitionBy("bin").orderBy("second_draw", "first_draw", "doc_id")
    permuted = rows.withColumn("place", F.row_number().over(locally).cast("long"))
    sent = permuted.join(ends, "source").withColumn("bin", F.size(F.filter("ends", lambda end: end < F.col("place"))))
    return (
        sent.withColumn("within", F.row_number().over(in_bin).cast("long") - 1)
        .join(offsets, "bin")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("within")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
