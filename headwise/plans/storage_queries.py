"""Sources and sinks (S): every dataset takes a round trip through storage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.operators import aggregates as A
from headwise.operators import compare as K
from headwise.operators import rollups as P
from headwise.plans import frames
from headwise.plans.catalog import query
from headwise.plans.frames import Layer, unique
from headwise.session import shared_folder
from headwise.sources import star, store

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{unique()}"


def _round_trip(spark, df, name: str):
    path = store.write_dataset(df, f"{_folder(spark)}/{name}")
    return store.read_dataset(spark, path, df.schema)


@query("S01_read_parquet", CUSTOMER)
def _(spark, root):
    return store.read_dataset(spark, f"{root}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("S01_read_csv", CUSTOMER)
def _(spark, root):
    path = store.write_dataset(star.table(spark, root, "customer"), f"{_folder(spark)}/customer.csv")
    return store.read_dataset(spark, path)


@query("S02_write_csv", CUSTOMER)
def _(spark, root):
    return _round_trip(spark, star.table(spark, root, "customer"), "customer.csv")


@query("S02_write_json_lines", CUSTOMER)
def _(spark, root):
    return _round_trip(spark, star.table(spark, root, "customer"), "customer.jsonl")


@query("S02_write_parquet_by_date", "SELECT CAST(date AS VARCHAR) AS date, count(*) AS trips, sum(boardings)::BIGINT AS boardings FROM trips_core GROUP BY 1")
def _(spark, root):
    trips = star.trips_core(spark, root).select("trip_id", "date", "boardings")
    path = store.write_dataset(trips.repartition("date"), f"{_folder(spark)}/trips.parquet", partition_by=["date"])
    schema = T.StructType([trips.schema["trip_id"], trips.schema["boardings"], trips.schema["date"]])
    back = store.read_dataset(spark, path, schema)
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("trips"), F.sum("boardings").alias("boardings"))


@query("S03_timestamps_to_micros", "SELECT event_id, epoch_us(ts) AS ts, value FROM events")
def _(spark, root):
    return store.times_to_micros(star.table(spark, root, "events").select("event_id", "ts", "value"))


@query("S04_micros_to_timestamp", "SELECT event_id, CAST(date_trunc('second', ts) AS VARCHAR) AS ts FROM events")
def _(spark, root):
    micros = store.times_to_micros(star.table(spark, root, "events").select("event_id", "ts"))
    return micros.select("event_id", F.date_trunc("second", store.to_timestamp(micros, "ts")).alias("ts"))


@query(
    "S05_area_listing",
    "SELECT 'nation.parquet' AS dataset, count(*) AS rows FROM nation UNION ALL SELECT 'region.parquet' AS dataset, count(*) AS rows FROM region",
)
def _(spark, root):
    base = _folder(spark)
    for name in ("region", "nation"):
        store.write_dataset(star.table(spark, root, name), store.area_uri(base, "processed", name))
    out = None
    for found in store.list_area(spark, base, "processed"):
        n = spark.read.parquet(f"{base}/processed/{found}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(found).alias("dataset"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


@query("S06_cluster_uri_round_trip", "SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders")
def _(spark, root):
    return _round_trip(spark, star.table(spark, root, "orders"), "orders.parquet")


@query("S07_mirrored_copies", f"SELECT 'parquet' AS format, count(*) AS rows, sum(c_acctbal) AS total FROM ({CUSTOMER}) UNION ALL SELECT 'csv', count(*), sum(c_acctbal) FROM ({CUSTOMER})")
def _(spark, root):
    df = star.table(spark, root, "customer")
    out = None
    for path in store.mirror(df, _folder(spark), "analytics", "customer"):
        one = store.read_dataset(spark, path, df.schema).agg(F.count(F.lit(1)).alias("rows"), F.sum("c_acctbal").alias("total"))
        one = one.select(F.lit(path.rsplit(".", 1)[-1]).alias("format"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("S08_tag_and_save", "SELECT route_id, time_band, trips_total, underused_share, '1.0' AS analytics_version FROM underutilization")
def _(spark, root):
    saved = store.save(A.underutilization(star.trips_core(spark, root)), _folder(spark), "underutilization")
    return saved.select("route_id", "time_band", "trips_total", "underused_share", "analytics_version")


@query(
    "S09_layer_row_counts",
    """SELECT 'overcrowding_events' AS dataset, count(*) AS rows FROM overcrowding_events UNION ALL SELECT 'quality_days', count(*) FROM quality_days
    UNION ALL SELECT 'daily_demand', count(*) FROM daily_demand UNION ALL SELECT 'anomalies', count(*) FROM anomalies""",
)
def _(spark, root):
    layer = Layer(spark, root)
    return store.layer_counts({n: layer[n] for n in ("overcrowding_events", "quality_days", "daily_demand", "anomalies")})


@query("S10_export_with_status_filter", "SELECT route_id, CAST(date AS VARCHAR) AS date, status, quality_score FROM quality_days WHERE status = 'critical'")
def _(spark, root):
    q = A.quality_days(star.trips_core(spark, root)).select("route_id", "date", "status", "quality_score")
    path = store.export(q, f"{_folder(spark)}/quality.csv", status="critical")
    return store.read_dataset(spark, path, q.schema)


@query(
    "S11_transposed_comparison",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(f"max(CASE WHEN route_id = {i} THEN CAST({m} AS DOUBLE) END) AS r{i}" for i in range(20)) + " FROM route_metrics"
        for m in K.METRIC_GROUPS["delay"]
    ),
)
def _(spark, root):
    long = K.compare(Layer(spark, root)["route_metrics"], None, ["delay"])
    return _round_trip(spark, K.transposed(long, "route_id", "r", always=range(20)), "comparison.csv")


@query("S12_report_bundle", "SELECT 'daily_demand' AS dataset, count(*) AS rows FROM daily_demand UNION ALL SELECT 'quality_days', count(*) FROM quality_days")
def _(spark, root):
    tables = {"daily_demand": frames.daily_demand(spark, root), "quality_days": A.quality_days(star.trips_core(spark, root))}
    paths = store.export_bundle(tables, _folder(spark))
    return store.layer_counts({n: spark.read.parquet(p) for n, p in paths.items()})


@query("S13_tolerant_log_tail", "SELECT event_id, value FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, root):
    e = star.table(spark, root, "events")
    line = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(
        F.to_json(F.struct("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value"))
    )
    path = f"{_folder(spark)}/metrics.jsonl"
    e.select(line.alias("value")).write.text(path)
    log = store.read_log(spark, path, "event_id long, us long, value double")
    return store.latest(log, "us", 50, "event_id").select("event_id", "value")


@query(
    "S14_development_sample",
    "SELECT trip_id, route_id, CAST(date AS VARCHAR) AS date FROM trips_core WHERE ('0x' || substr(md5(CAST(trip_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 10",
)
def _(spark, root):
    return store.development_sample(star.trips_core(spark, root), ["trip_id"], full=False, percent=10).select("trip_id", "route_id", "date")


@query("S15_column_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(spark, root):
    return star.table(spark, root, "lineitem").select("l_orderkey", "l_quantity")


@query("L01_append_entries", "SELECT event_id, epoch_us(ts) AS us, action, component, status FROM run_log")
def _(spark, root):
    """Two batches appended one after the other read back as one log."""
    log, path = star.run_log(spark, root), f"{_folder(spark)}/run_log.parquet"
    P.append_log(log.where("status = 'ok'"), path)
    P.append_log(log.where("status != 'ok'"), path)
    return spark.read.schema(log.schema).parquet(path).select("event_id", F.unix_micros("ts").alias("us"), "action", "component", "status")


@query(
    "K09_filtered_accessor",
    "SELECT route_id, CAST(date AS VARCHAR) AS date, passengers FROM daily_demand WHERE route_id IN (0, 1, 3) AND CAST(date AS DATE) BETWEEN DATE '1994-06-01' AND DATE '1996-12-31'",
)
def _(spark, root):
    folder = _folder(spark)
    frames.daily_demand(spark, root).write.parquet(f"{folder}/daily_demand.parquet")
    found = K.DataAccess(spark, folder).daily_demand([0, 1, 3], "1994-06-01", "1996-12-31")
    return found.select("route_id", F.col("date").cast("string").alias("date"), "passengers")


@query("K09_filtered_events", "SELECT route_id, count(*) AS events FROM overcrowding_events WHERE severity IN ('critical') GROUP BY 1")
def _(spark, root):
    folder = _folder(spark)
    Layer(spark, root)["overcrowding_events"].write.parquet(f"{folder}/overcrowding_events.parquet")
    found = K.DataAccess(spark, folder).overcrowding_events(severity=["critical"])
    return found.groupBy("route_id").agg(F.count(F.lit(1)).alias("events"))
