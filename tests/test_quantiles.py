import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.functions.quantiles import exact_column_quantiles, exact_quantile_scalar, exact_quantiles, tail_z

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than half of the rows; another holds two, another only nulls."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.lognormal(1.0, 2.0, 20_000)]
    rows += [("flat", 7.0)] * 9_000 + [("mid", float(round(x, 1))) for x in rng.normal(0, 3, 6_000)]
    rows += [("pair", 1.0), ("pair", 2.0), ("none", None)]
    return rows


@pytest.mark.parametrize("small_group", [16, 4096, 10**9])
def test_equals_linear_interpolation(spark, skewed, small_group):
    df = spark.createDataFrame(skewed, "k string, v double").repartition(7)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", PROBS, small_group=small_group).collect()}
    for key in ("hot", "flat", "mid", "pair"):
        values = np.array([v for k, v in skewed if k == key])
        for name, p in PROBS.items():
            assert got[key][name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12), (key, name)
    assert "none" not in got


def test_bracket_leaves_out_most_of_a_hot_group(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v double")
    out = exact_quantiles(df, ["k"], "v", {"q": 0.5}, small_group=1000, accuracy=10_000)
    assert out.count() == 4


def test_companion_aggregates_and_persisting(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v double")
    kept = []
    out = exact_quantiles(
        df, ["k"], "v", {"q": 0.5}, aggs=[F.count(F.lit(1)).alias("rows")], keep=lambda d, n: kept.append(n) or d
    )
    rows = {r["k"]: (r["rows"], r["q"]) for r in out.collect()}
    assert kept == ["group_sizes"]
    assert rows["flat"] == (9_000, 7.0) and rows["none"] == (1, None)


@pytest.mark.parametrize("small_group", [16, 10**9])
def test_null_keys_are_a_group(spark, small_group):
    rows = [(None, float(i % 37)) for i in range(500)] + [("a", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for aggs in ([], [F.count(F.lit(1)).alias("rows")]):
        got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", {"q": 0.3}, small_group=small_group, aggs=aggs).collect()}
        assert got == {k: pytest.approx(float(np.quantile([v for x, v in rows if x == k], 0.3))) for k in (None, "a")}


def test_whole_frame_scalar(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v double")
    got = df.limit(1).select(exact_quantile_scalar(df, "v", 0.9)).first()[0]
    assert got == pytest.approx(float(np.quantile([v for _, v in skewed if v is not None], 0.9)))


def test_normal_tail():
    assert tail_z(0.9) == pytest.approx(1.2816, abs=1e-4)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_small_groups_are_not_sketched(spark, skewed):
    """A sketch of a group of a few rows is larger than its rows."""
    df = spark.createDataFrame([(i % 300, float(i)) for i in range(3000)], "k int, v double")
    out = exact_quantiles(df, ["k"], "v", {"q": 0.95}, aggs=[F.count(F.lit(1)).alias("rows")])
    assert "percentile_approx" not in _plan(out)
    assert {r["k"]: (r["rows"], r["q"]) for r in out.collect()} == {
        k: (10, pytest.approx(float(np.quantile(np.arange(k, 3000, 300), 0.95)))) for k in range(300)
    }


def test_column_quantiles_keep_rows_whole(spark):
    """Several columns: NaN and null are left out, an all-null column has no row, a row never becomes one for each column."""
    rng = np.random.default_rng(5)
    rows = [(float(x), None if i % 3 else float(i), float("nan") if i % 2 else 4.0, None) for i, x in enumerate(rng.normal(0, 9, 4000))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    for small_group in (16, 1000, 10**9):
        out = exact_column_quantiles(df, list("abcd"), 0.3, accuracy=1000, small_group=small_group)
        got = {r["column"]: r["q"] for r in out.collect()}
        assert got == {
            "a": pytest.approx(float(np.quantile([r[0] for r in rows], 0.3))),
            "b": pytest.approx(float(np.quantile([r[1] for r in rows if r[1] is not None], 0.3))),
            "c": 4.0,
        }
        assert "Join" not in _plan(out)
