"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the sizing: coalesced shuffles, skewed joins split, small sides broadcast by measured size.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "headwise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names for durable intermediates.

    Only a local session, whose executors are the driver, may go without: it gets a temporary folder. A cluster that
    names none is refused, because each executor would write to its own disk and later reads would miss the files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="headwise-")
    return _OWN_FOLDERS[app]


COMPACT = "zstd"  # of wide rows of numbers a sixth to a quarter less than the default, read as fast
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[int, int] = {}
_BEFORE: dict[int, str | None] = {}
_FREEING_LOCK = threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are removed when a query ends, not when the driver next collects garbage.

    For queries that are executed once, as writes are. The setting is that of the session, so threads that write at
    once share it: the first one sets it, the last one puts the old value back.
    """
    key = id(spark)
    with _FREEING_LOCK:
        if not _FREEING.get(key):
            _BEFORE[key] = spark.conf.get(_FREE, None)
            spark.conf.set(_FREE, "true")
        _FREEING[key] = _FREEING.get(key, 0) + 1
    try:
        yield
    finally:
        with _FREEING_LOCK:
            _FREEING[key] -= 1
            if not _FREEING[key]:
                old = _BEFORE.pop(key)
                spark.conf.unset(_FREE) if old is None else spark.conf.set(_FREE, old)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several outputs read, and return the scan of it.

    The lineage ends at files in the shared folder, so a lost executor costs one re-read, and each consumer
    prunes columns and pushes filters into its own scan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialise`` whose tables live as long as the context: for rows that nothing reads once a result is written."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        with freed_shuffles(spark):
            df.write.mode("error").option("compression", COMPACT).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
