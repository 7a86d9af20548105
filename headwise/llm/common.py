"""Helpers shared by the corpus operators: scratch tables, null-free texts, Arrow batches by key."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that ``spark.checkpoint.dir`` names.

    A local session without that setting, as in tests, gets a temporary folder; a cluster without it is refused,
    because executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="headwise-llm-"))
    return f"{folder}/llm-{name}-{uuid.uuid4().hex}"


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Send batches of so many rows to Python for now: a batch of whole texts is held on both sides of the pipe."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and return its scan: the lineage ends there, and its size is known."""
    path = scratch_path(df.sparkSession, name)
    with short_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of few rows that stands in the plan itself, so that no worker is needed to make it."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def text_of(column: str = "text") -> Column:
    """The text; null is the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_SOLE: dict[str, Callable[[], None]] = {}


def sole_memory(name: str, forget: Callable[[], None]) -> None:
    """Say that this worker now remembers things for one operator, and drop what it kept for another before.

    Python workers outlive a stage; without this, each stage of a pipeline would leave its memory to the next.
    """
    if name not in _SOLE:
        for other in list(_SOLE.values()):
            other()
        _SOLE.clear()
        _SOLE[name] = forget
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds what it remembers and no more."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column without nulls, and where each row begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_runs(texts: pa.Array, bound: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows whose texts add up to the bound, or of single rows of longer ones."""
    ends, start = row_bytes(texts)[1], 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + bound, side="right")) - 1)
        yield start, stop - start
        start = stop


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, bound: int) -> Iterator[pa.RecordBatch]:
    """Such runs of all batches, by the texts of one column; memory goes back to the system at the end."""
    for batch in batches:
        for start, rows in text_runs(batch.column(column), bound):
            yield batch.slice(start, rows)
    give_back()


def at_most(rows: list, size: Callable[[object], int], bound: int) -> Iterator[list]:
    """Cut a list of items into runs whose sizes add up to the bound, or hold one item."""
    run, total = [], 0
    for item in rows:
        n = size(item)
        if run and total + n > bound:
            yield run
            run, total = [], 0
        run.append(item)
        total += n
    if run:
        yield run


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and keys[start] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield pa.Table.from_batches(held)


@dataclass(frozen=True)
class Documents:
    """Names of the columns that the corpus operators read."""

    id: str = "doc_id"
    text: str = "text"
    source: str = "source"
    lang: str = "lang"


_SHIPPED: set[str] = set()
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, where they cannot find it by the paths that the driver was given."""
    app = spark.sparkContext.applicationId
    known = {os.path.abspath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]}
    if app in _SHIPPED or _ROOT in known:
        return
    whole = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="headwise-package-"), "headwise"), "zip", _ROOT, "headwise")
    spark.sparkContext.addPyFile(whole)
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
