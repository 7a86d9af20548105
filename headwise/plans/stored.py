"""Derived tables that are kept under the shared folder and reused as long as their inputs are the same.

A table is named by a digest of what it was made from: its name, the files of its inputs (path, size, modification time),
the settings that shape it and the source of this package. A call with the same inputs reads the table that an earlier one wrote; a changed, added or
removed file, or another setting, gives another name, so that the table is built again. A build writes to a folder of its
own and becomes visible by one rename; of two builders at once the later one takes the table of the earlier one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from headwise.session import COMPACT, freed_shuffles, shared_folder

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@lru_cache(maxsize=1)
def source_digest() -> str:
    """Digest of the package's modules: tables of an earlier release are not read."""
    root = Path(__file__).resolve().parent.parent
    modules = sorted(p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts)
    return hashlib.sha256(b"".join(p.read_bytes() for p in modules)).hexdigest()


def input_files(spark: SparkSession, root: str, tables: Sequence[str] = STAR) -> list[tuple[str, int, int]]:
    """Path, size and modification time of every file of these tables, in order; missing tables have none."""
    out = []
    for table in tables:
        at, fs = _folder(spark, f"{root}/{table}.parquet")
        if fs.exists(at):
            found = fs.listFiles(at, True)
            while found.hasNext():
                f = found.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def stored(
    spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], settings: object = None, tables: Sequence[str] = STAR
) -> DataFrame:
    """The table of this name for these inputs: read where it is kept already, else built and kept."""
    made_from = repr((name, input_files(spark, root, tables), settings, source_digest()))
    path = f"{shared_folder(spark)}/stored-{name}-{hashlib.sha256(made_from.encode()).hexdigest()[:32]}"
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        df = build()
        own = f"{path}-{uuid.uuid4().hex}"
        with freed_shuffles(spark):
            df.write.mode("error").option("compression", COMPACT).parquet(own)
        own_at, _ = _folder(spark, own)
        if fs.exists(at) or not fs.rename(own_at, at):
            fs.delete(own_at, True)  # another builder was first
    return spark.read.parquet(path)
