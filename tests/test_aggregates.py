import pytest
from pyspark.sql import functions as F

from headwise.operators import aggregates as A
from headwise.operators import cleaning as C
from headwise.operators import joins as J


def test_headway_reliability_within_a_fifth(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", "morning peak", 10.0, x) for x in (9.0, 10.0, 11.0, 13.0)],
        "route_id long, date string, time_band string, scheduled_headway_min double, actual_headway_min double",
    )
    for keys in (["route_id", "time_band"], ["route_id", "date", "time_band"]):
        rows = A.headway_reliability(df, keys).collect()
        assert len(rows) == 1 and rows[0]["headway_reliability"] == pytest.approx(0.75)


def test_critical_days_are_counted(spark):
    rows = [(1, f"2024-01-{d:02d}", "midday", 2, "critical" if d < 4 else "high") for d in range(1, 17)]
    rows += [(1, "2024-01-01", "night", 5, "critical"), (2, "2024-01-01", "midday", 1, "high")]
    df = spark.createDataFrame(rows, "route_id long, date string, time_band string, trips_total long, severity string")
    got = A.persistent_overcrowding(df).collect()
    assert [(r["route_id"], r["crowded_days"], r["critical_days"], r["all_crowded_trips"], r["peak_crowding_bands"]) for r in got] == [
        (1, 16, 3, 37, "midday, night")
    ]


def test_row_guard(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    right = spark.createDataFrame([(1, 10), (1, 11)], "k long, x long")
    assert J.check_no_multiply(left, left.join(right.dropDuplicates(["k"]), "k", "left"), ["k"])["rows_with_missing_context"] == 1
    with pytest.raises(ValueError, match="row count"):
        J.check_no_multiply(left, left.join(right, "k", "left"), ["k"])
    assert J.add_context(left, left.withColumn("n", F.lit(1)), "k").columns == ["k", "s", "n"]


def test_messy_ids(spark):
    ref = spark.createDataFrame([("R-001",), ("R-020",)], "route_id string")
    df = spark.createDataFrame([("r001",), (" R-001 ",), ("R 020",), ("R-9",), (None,)], "route_id string")
    assert sorted(str(r[0]) for r in C.canonical_ids(df, "route_id", ref, "route_id").collect()) == ["None", "None", "R-001", "R-001", "R-020"]


def test_first_copy_of_a_hot_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id").unionByName(spark.createDataFrame([(2, 7)], "k int, id long"))
    assert sorted((r["k"], r["id"]) for r in C.keep_first(df, ["k"], ["id"]).collect()) == [(1, 0), (2, 7)]


def test_small_repairs(spark):
    df = spark.createDataFrame(
        [(None, 2.0, "day", "mini", 0), (5.0, 1.0, "x", "tram", None)], "fare double, km double, pass_type string, kind string, cap int"
    )
    out = df.select(
        C.recomputed_fare("fare", "km", "pass_type").alias("fare"),
        C.default_by_type("cap", "kind", {"mini": 45}, 80).alias("cap"),
        C.or_default("pass_type", ("day",), "single").alias("p"),
    ).collect()
    assert [tuple(r) for r in out] == [(pytest.approx((18 + 8.4) * 0.75), 45, "day"), (5.0, 80, "single")]


def test_whole_layer_clean_and_log(spark, small, tmp_path):
    from headwise.session import materialise
    from headwise.sources import star

    raw = {
        "routes": star.route_names(spark, small).withColumn("category", F.lit("core")),
        "stops": star.stop_names(spark, small),
        "vehicles": star.raw_vehicles(spark, small),
        "vehicle_pools": star.vehicle_pools(spark, small),
        "trips": star.raw_trips(spark, small),
        "stop_trips": star.raw_visits(spark, small).withColumn("trip_id", F.col("trip_id") * 10 + F.col("seq")),
        "tickets": star.raw_tickets(spark, small).withColumn("trip_id", F.col("ticket_id")).withColumn("route_id", F.lit("R-000")),
    }
    order = {"trips": star.TRIP_ORDER, "stop_trips": star.VISIT_ORDER, "tickets": star.TICKET_ORDER}
    cleaned, log = C.clean_all(raw, order, materialise)
    entries = {(r["dataset"], r["operation"]): r["rows_affected"] for r in log.frame().collect()}
    assert entries[("trips", "drop duplicate trip_id")] == raw["trips"].count() - raw["trips"].select("trip_id").distinct().count()
    assert cleaned["trips"].count() == cleaned["schedules"].count() > 0
    assert cleaned["trips"].where("occupancy_max_pct < occupancy_avg_pct - 1e-9").count() == 0
    assert cleaned["tickets"].where("fare is null or distance_km is null or passenger_id is null").count() == 0
