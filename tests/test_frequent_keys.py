"""Joins in which very many rows hold one key, or none."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from headwise.operators import cleaning as C
from headwise.operators import models as Mo
from headwise.operators import recommendations as R


@pytest.fixture(scope="module")
def rides(spark):
    rows = [(i, f"r{i % 2}", None if i % 3 == 0 else (99 if i % 3 == 1 else i % 5)) for i in range(600)]
    return spark.createDataFrame(rows, "trip_id int, route_id string, vehicle_id int").repartition(4)


@pytest.fixture(scope="module")
def vehicles(spark):
    return spark.createDataFrame([(0, 10), (1, 11), (1, 12), (2, 13), (None, 14)], "vehicle_id int, capacity int")  # one key twice, one null


def test_rows_without_a_key_are_dealt_into_pieces(spark, rides, vehicles):
    pool = spark.createDataFrame([("r0", 2, 1), ("r0", 0, 2)], "route_id string, vehicle_id int, place int")
    kept = []
    out = C.repair_from_pool(rides, "vehicle_id", vehicles, "route_id", pool, "place", keep=lambda d, n: kept.append(n) or d)
    assert kept == ["pool_first"] and set(out.columns) == set(rides.columns)
    want = {}
    for r in rides.collect():
        known = r.vehicle_id in (0, 1, 2)
        want[r.trip_id] = 0 if r.vehicle_id is None else r.vehicle_id if known else 2 if r.route_id == "r0" else 0
    assert {r.trip_id: r.vehicle_id for r in out.collect()} == want and out.count() == 600
    assert "_piece" in out._jdf.queryExecution().analyzed().toString()


def test_lookup_of_frequent_keys_keeps_every_row_and_copy(spark, rides, vehicles):
    frequent = spark.createDataFrame([(1,), (99,), (None,)], "vehicle_id int")
    plain = C.lookup_chain(rides, "vehicle_id", vehicles, "capacity", 80)
    dealt = C.lookup_chain(rides, "vehicle_id", vehicles, "capacity", 80, frequent)
    assert set(dealt.columns) == set(plain.columns)
    cols = sorted(plain.columns)
    assert Counter(map(tuple, dealt.select(*cols).collect())) == Counter(map(tuple, plain.select(*cols).collect()))


def test_medians_are_found_only_where_a_frame_has_a_gap(spark, monkeypatch):
    asked, found = [], Mo.exact_column_quantiles
    monkeypatch.setattr(Mo, "exact_column_quantiles", lambda df, cols, p: asked.append(list(cols)) or found(df, cols, p))
    train = spark.createDataFrame([(1.0, 2.0, None), (3.0, 4.0, None), (5.0, 9.0, None)], "a double, b double, c double")
    test = spark.createDataFrame([(1.0, float("nan"), None), (7.0, 1.0, 3.0)], "a double, b double, c double")
    out = Mo.with_imputation(train, [train, test], ["a", "b", "c"])
    assert asked == [["b", "c"]]
    assert sorted(map(tuple, out[1].collect())) == [(1.0, 4.0, 0.0), (7.0, 1.0, 3.0)]


def test_only_visits_of_bottlenecks_reach_the_serving_routes(spark, monkeypatch):
    seen, serving = [], R.serving_routes
    monkeypatch.setattr(R, "serving_routes", lambda v: seen.append({r.stop_id for r in v.collect()}) or serving(v))
    stops = spark.createDataFrame(
        [(1, True, 90.0), (2, False, 10.0), (None, True, 95.0)], "stop_id int, is_bottleneck boolean, bottleneck_score double"
    )
    for c in ("avg_arr_delay_min", "p95_arr_delay_min", "crowding_share", "boardings"):
        stops = stops.withColumn(c, F.lit(1.0))
    stops = stops.withColumns({"peak_hour": F.lit(8), "stop_name": F.lit("x")})
    visits = spark.createDataFrame([(1, 7), (1, 5), (2, 5), (None, 4)], "stop_id int, route_id int")
    out = R.stop_recommendations(stops, visits, now="2024-02-01T00:00:00")
    assert seen == [{1}]
    assert {r.affected_stop: r.routes_serving for r in out.collect() if r.affected_stop} == {"1": ["5", "7"]}
