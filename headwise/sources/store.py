"""Dataset reading, writing, addressing and export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AREAS = ("raw", "cleaned", "processed", "features", "analytics", "models")
ANALYTICS_VERSION = "1.0"
_TIMES = (T.TimestampType, T.TimestampNTZType)


def _format_of(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in ("parquet", "csv", "json", "jsonl"):
        raise ValueError(f"Unsupported file format: .{ext}")
    return ext


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read by extension. A ``.json`` file may hold one multi-line array, ``.jsonl`` holds one object per line.

    Pass a schema for large text inputs; without one they are scanned once more to infer it.
    """
    ext = _format_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ext == "parquet":
        return reader.parquet(path)
    if ext == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.json(path, multiLine=ext == "json")


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Overwrite a dataset in the format of its extension; the committer publishes all of it or nothing."""
    ext = _format_of(path)
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if ext == "parquet":
        writer.parquet(path)
    elif ext == "csv":
        writer.csv(path, header=True)
    else:
        writer.json(path)
    return path


def times_to_micros(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds since the epoch, for engines without a timestamp type."""
    return df.select(
        *[
            F.unix_micros(F.col(f.name).cast("timestamp")).alias(f.name) if isinstance(f.dataType, _TIMES) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def to_timestamp(df: DataFrame, column: str) -> Column:
    """Inverse of ``times_to_micros``: microseconds or text to a timestamp, unparsable text to null."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.timestamp_micros(F.col(column))
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.col(column))
    return F.col(column).cast("timestamp")


def area_uri(base: str, area: str, name: str = "", fmt: str = "parquet") -> str:
    """Address of an area, or of a dataset in it, under any Hadoop file-system base."""
    if area not in AREAS:
        raise ValueError(f"Unknown area: {area}")
    root = f"{base.rstrip('/')}/{area}"
    return f"{root}/{name}.{fmt}" if name else root


def _file_system(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _file_system(spark, uri)
    return fs.exists(path)


def list_area(spark: SparkSession, base: str, area: str) -> list[str]:
    """Names of the datasets in an area."""
    uri = area_uri(base, area)
    if not exists(spark, uri):
        return []
    fs, path = _file_system(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def mirror(df: DataFrame, base: str, area: str, name: str, formats: Sequence[str] = ("parquet", "csv")) -> list[str]:
    """A copy of a dataset in an area, once per format. Later formats read the first copy back, not the plan."""
    spark = df.sparkSession
    written = []
    for fmt in formats:
        source = df if not written else read_dataset(spark, written[0], df.schema)
        written.append(write_dataset(source, area_uri(base, area, name, fmt)))
    return written


def tagged(df: DataFrame, version: str = ANALYTICS_VERSION) -> DataFrame:
    return df.withColumn("analytics_version", F.lit(version))


def save(df: DataFrame, base: str, name: str) -> DataFrame:
    """Tag, persist in the analytics area, and return the scan of what was written."""
    path = write_dataset(tagged(df), area_uri(base, "analytics", name))
    return df.sparkSession.read.parquet(path)


def layer_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every dataset of a layer."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def with_status(df: DataFrame, status: Sequence[str] | str | None) -> DataFrame:
    """Rows in the given states; no state given means all rows."""
    if not status:
        return df
    return df.where(F.col("status").isin([status] if isinstance(status, str) else list(status)))


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def export(df: DataFrame, path: str, status: Sequence[str] | str | None = None, one_file: bool = False) -> str:
    """Export to CSV, JSON or Parquet. ``one_file`` suits report tables only: it writes through a single task."""
    out = with_status(df, status)
    if _format_of(path) == "csv":
        out = flattened(out)
    return write_dataset(out.coalesce(1) if one_file else out, path)


def export_bundle(frames: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Many tables in one run, under one time-stamped prefix."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    return {name: export(df, f"{folder.rstrip('/')}/{stamp}/{name}.{fmt}") for name, df in frames.items()}


def read_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON-lines log; malformed lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def latest(df: DataFrame, time: str, limit: int, *ties: str) -> DataFrame:
    """The last rows by time."""
    return df.orderBy(F.col(time).desc(), *ties).limit(limit)


def development_sample(df: DataFrame, keys: Sequence[str], full: bool = True, percent: int = 1) -> DataFrame:
    """All rows, or a stable hash sample of the keys (md5, which other engines have too) for development runs."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return df if full else df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent)
