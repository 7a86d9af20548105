import pytest
from pyspark.sql import functions as F

from headwise.operators import alerts as D
from headwise.operators import compare as K
from headwise.operators import recommendations as R


def evidence(values):
    if not values:
        return F.create_map(F.lit("none"), F.lit(0.0))
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


@pytest.mark.parametrize(
    "kind, values, want",
    [
        ("persistent_overcrowding", {"critical_days": 35}, "critical"),
        ("persistent_overcrowding", {"crowded_days": 25}, "high"),
        ("critical_crowding_event", {"critical_share_pct": 60}, "critical"),
        ("severe_delay", {"avg_delay_min": 25}, "critical"),
        ("severe_delay", {"severe_pct": 40}, "high"),
        ("stop_bottleneck", {"score": 95}, "critical"),
        ("demand_anomaly", {"abs_z_score": 4.5}, "high"),
        ("demand_anomaly", {}, "medium"),
        ("persistent_overcrowding", {}, "critical"),
        ("bunching_persistent", {}, "high"),
    ],
)
def test_severity_escalates(spark, kind, values, want):
    assert spark.range(1).select(D.alert_severity(F.lit(kind), evidence(values))).first()[0] == want


@pytest.mark.parametrize(
    "values, want",
    [
        ({"crowding_share": 0.45}, "CRITICAL"),
        ({"on_time_share": 0.50}, "CRITICAL"),
        ({"crowding_share": 0.30}, "HIGH"),
        ({"bunching_share": 0.20}, "MEDIUM"),
        ({"crowding_share": 0.05, "on_time_share": 0.90}, "LOW"),
        ({}, "LOW"),
    ],
)
def test_priority_tiers(spark, values, want):
    assert spark.range(1).select(R.priority_of(evidence(values))).first()[0] == want


def test_status_lifecycle(spark, tmp_path):
    alerts = spark.createDataFrame(
        [("a", "new", None, None), ("b", "new", None, None)], "alert_id string, status string, acknowledged_at string, resolved_at string"
    )
    ids = spark.createDataFrame([("a",)], "alert_id string")
    assert D.save_status(alerts, ids, "acknowledged", "2024-02-01", f"{tmp_path}/v1") == 1
    rows = {r["alert_id"]: r for r in spark.read.parquet(f"{tmp_path}/v1").collect()}
    assert rows["a"]["status"] == "acknowledged" and rows["a"]["acknowledged_at"] == "2024-02-01"
    assert rows["b"]["status"] == "new"
    assert D.save_status(alerts, ids.where("alert_id = 'z'"), "resolved", "x", f"{tmp_path}/v2") == 0
    with pytest.raises(ValueError):
        D.update_status(alerts, ids, "closed", "x")


ROUTE = (1, 10000.0, 50.0, 5.0, 0.85, 55.0, 85.0, 0.1, 10.0, 0.2, 0.1, 40.0)
def test_filters_are_no_ops_without_criteria(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05"), (3, "2024-01-09")], "route_id long, date string")
    assert K.filter_in(df, "route_id", [1, 3]).count() == 2
    assert K.filter_in(df, "route_id", []).count() == 3
    assert K.filter_in(df, "severity", ["high"]).count() == 3
    assert K.filter_dates(df, "date", "2024-01-08").count() == 1
    assert K.filter_dates(df, "date", "2024-01-02").count() == 2
    assert K.filter_dates(df, "date", None, "2024-01-05").count() == 2
    assert K.filter_dates(df, "absent", "2024-01-08").count() == 3


def test_metric_groups_accept_any_spelling():
    columns = list(K.METRIC_SPECS)
    assert K.metrics_of(["Route Info"], columns) == ["category", "length_km"]
    assert K.metrics_of(["nothing"], columns) == columns
    for group in K.METRIC_GROUPS.values():
        assert all(m in K.METRIC_SPECS for m in group)


def test_accessors_over_saved_tables(spark, tmp_path):
    spark.createDataFrame([(1, "high"), (2, "critical")], "route_id long, severity string").write.parquet(f"{tmp_path}/overcrowding_events.parquet")
    access = K.DataAccess(spark, str(tmp_path))
    assert access.overcrowding_events(severity=["critical"]).count() == 1
    assert access.overcrowding_events(route_ids=[1, 2]).count() == 2


def test_difference_needs_two_values(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (2, "a", 4.0), (1, "b", 9.0)], "route_id long, metric string, value double")
    out = K.median_differences(long).collect()
    assert {(r["metric"], r["difference"]) for r in out} == {("a", -1.5), ("a", 1.5)}


def test_unknown_ranking_metric(spark):
    with pytest.raises(ValueError):
        K.rank(spark.range(1), "speed")


def test_transposed_comparison_holds_every_entity(spark):
    long = spark.createDataFrame([(i, "m", float(i)) for i in (3, 25, 117)] + [(25, "n", 1.0)], "route_id long, metric string, value double")
    out = {r["metric"]: r.asDict() for r in K.transposed(long, "route_id", "r").collect()}
    assert out == {"m": {"metric": "m", "r3": 3.0, "r25": 25.0, "r117": 117.0}, "n": {"metric": "n", "r3": None, "r25": 1.0, "r117": None}}
    with pytest.raises(ValueError, match="more than 2"):
        K.transposed(long, "route_id", "r", limit=2)
