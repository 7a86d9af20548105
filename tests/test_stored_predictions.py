"""P15 and P17 over what M12 and M15 wrote."""

from headwise.plans import model_queries
from headwise.plans.catalog import load

SERIES = "route_id long, date string, time_band string, predicted double, lower_bound double, upper_bound double"


def rows_of(spark, name, small):
    return [r.asDict() for r in load()[name].build(spark, small).collect()]


def test_summaries_read_the_model_outputs(spark, small, monkeypatch):
    stored = [(1, "2024-01-30", "night", 90.0, 81.0, 93.0), (1, "2024-01-30", "midday", 80.0, 75.0, 99.0), (2, "2024-01-30", "night", 10.0, 0.0, 12.0)]
    built = []

    def made(spark, root):
        built.append(root)
        return spark.createDataFrame(stored, SERIES)

    monkeypatch.setattr(model_queries, "occupancy_forecast", made)
    monkeypatch.setattr(model_queries, "delay_prediction", made)
    summary = {"predictions": 3, "avg_predicted": 60.0, "max_predicted": 90.0}
    assert rows_of(spark, "P15_stored_forecast_summary", small) == [summary | {"high_count": 1}]
    assert rows_of(spark, "P17_stored_delay_summary", small) == [summary | {"high_count": 2}]
    means = {r["route_id"]: r for r in rows_of(spark, "P15_stored_forecast_route_means", small)}
    assert means == {
        1: {"route_id": 1, "predicted": 85.0, "lower_bound": 78.0, "upper_bound": 96.0},
        2: {"route_id": 2, "predicted": 10.0, "lower_bound": 0.0, "upper_bound": 12.0},
    }
    assert {r["route_id"]: r["predicted"] for r in rows_of(spark, "P17_stored_delay_route_means", small)} == {1: 85.0, 2: 10.0}
    assert built == [small] * 4


def test_real_forecast_has_residual_bounds(spark, small):
    means = rows_of(spark, "P15_stored_forecast_route_means", small)
    assert means and any(abs(r["upper_bound"] - r["predicted"] - 12) > 0.01 for r in means)
    assert all(r["lower_bound"] <= r["upper_bound"] for r in means)
