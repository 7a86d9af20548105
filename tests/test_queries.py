"""A cross-section of the registered queries against DuckDB on the smallest data, and the driver contract."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from headwise.plans.catalog import load

CHECKED = (
    "A06_route_metrics_ranked", "A10_stop_bottlenecks", "A18_event_impact", "A23_persistent_overcrowding", "A27_passenger_segmentation",
    "A32_service_level", "A35_route_reliability_profile", "B01_numeric_profile", "C24_cleaning_log", "C26_clean_trips",
    "D10_all_alerts", "F10_calendar_window_stats", "F13_prior_stats_network_day", "F16_rolling_previous_rows", "F19_trip_history_frame",
    "G05_segment_lengths", "J08_last_event_of_day", "K06_route_profiles", "L06_weekly_volumes", "M17_overall_metrics",
    "P04_route_date_matrix", "Q01_baseline_row", "R09_all_recommendations", "S02_write_csv", "V11_validate_layer", "X14_text_template",
)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, small, con, name):
    q = load()[name]
    assert differences(q.build(spark, small), con, q.sql) == []


def test_contract():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 230
    assert all(name[0].isupper() and name[1:3].isdigit() for name in load())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "reliability_flag" in df.columns
