import numpy as np
import pytest

from headwise.operators import features as Fe

SCHEMA = "id long, route string, day int, y double"


def rows(n=600, seed=3):
    """Unbalanced: one route holds most rows, routes prefer days, one route is null."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        route = 0 if rng.random() < 0.6 else int(rng.integers(1, 6))
        day = int(rng.integers(0, 4) + (3 if route % 2 else 0))
        out.append((i, None if route == 5 else f"R{route}", day, float(2 * route - day + rng.normal())))
    return out


def ridge(data, k):
    """The penalised least squares solution, solved whole."""
    routes, days = sorted({r[1] for r in data}, key=str), sorted({r[2] for r in data})
    x = np.zeros((len(data), len(routes) + len(days)))
    for i, r in enumerate(data):
        x[i, routes.index(r[1])] = x[i, len(routes) + days.index(r[2])] = 1
    y = np.array([r[3] for r in data])
    beta = np.linalg.solve(x.T @ x + k * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    return dict(zip(routes, beta)), dict(zip(days, beta[len(routes) :])), y.mean()


def test_effects_are_the_ridge_solution(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    of_route, of_day, mean = ridge(data, 5.0)
    for r in Fe.backfitted_effects(df, df, "y", ["day", "route"], 5.0, rounds=40, tolerance=1e-8).collect():
        assert r["route_effect"] == pytest.approx(of_route[r["route"]], abs=1e-6)
        assert r["day_effect"] == pytest.approx(of_day[r["day"]], abs=1e-6)
        assert r["signal"] == pytest.approx(mean + of_route[r["route"]] + of_day[r["day"]], abs=1e-6)
        assert r["residual"] == pytest.approx(r["y"] - r["signal"])


def test_one_round_is_the_sequential_pass(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    once = {r["id"]: r["signal"] for r in Fe.backfitted_effects(df, df, "y", ["route", "day"], 5.0, rounds=1).collect()}
    for r in Fe.shrunk_effects(df, df, "y", ["route", "day"], 5.0).collect():
        assert once[r["id"]] == pytest.approx(r["signal"])


def test_unseen_groups_null_values_and_no_rows(spark):
    data = rows(100)
    fit = spark.createDataFrame([*data, (900, "R1", 1, None)], SCHEMA)
    asked = spark.createDataFrame([(1, "new", 77, 1.0), (2, "R0", 1, None)], SCHEMA)
    of_route, of_day, mean = ridge(data, 5.0)
    new, old = sorted(Fe.backfitted_effects(asked, fit, "y", ["route", "day"], 5.0, tolerance=1e-8).collect(), key=lambda r: r["id"])
    assert (new["route_effect"], new["day_effect"]) == (0.0, 0.0) and new["signal"] == pytest.approx(mean)
    assert old["signal"] == pytest.approx(mean + of_route["R0"] + of_day[1], abs=1e-6) and old["residual"] is None
    empty = Fe.backfitted_effects(asked, fit.limit(0), "y", ["route", "day"], 5.0).collect()
    assert [r["signal"] for r in empty] == [None, None]
