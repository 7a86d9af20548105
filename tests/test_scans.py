import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise.functions import scans
from headwise.operators import features as Fe


@pytest.fixture(scope="module")
def moves(spark):
    """A hot group with two thirds of the rows, ties on the clock, and sparse chunks."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.66 else rng.choice("abc")
        t = rng.choice([rng.randrange(0, 50), rng.randrange(4000, 4100), rng.randrange(9000, 12000)])
        rows.append((key, t, i, float(rng.randrange(-50, 500)) / 10))
    return spark.createDataFrame(rows, "k string, t long, id long, v double").repartition(5).cache()


def same(got, want, name):
    a = {r["id"]: r[name] for r in got.select("id", name).collect()}
    b = {r["id"]: r[name] for r in want.select("id", name).collect()}
    assert a.keys() == b.keys()
    for i in a:
        if b[i] is None:
            assert a[i] is None, (i, a[i])
        else:
            assert a[i] == pytest.approx(b[i], abs=1e-9), i


def win():
    return W.partitionBy("k").orderBy("t", "id")


def chunk():
    return F.floor(F.col("t") / 100)


def test_previous_value_across_chunks(moves):
    got = scans.previous_values(moves, ["k"], ["t", "id"], chunk(), {"p": "v"})
    same(got, moves.withColumn("p", F.lag("v").over(win())), "p")


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_and_max(moves, inclusive):
    frame = win().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    got = scans.prior_aggregates(
        moves, ["k"], ["t", "id"], chunk(), {"s": F.col("v")}, {"m": F.col("v")}, inclusive=inclusive
    )
    same(got, moves.withColumn("s", F.coalesce(F.sum("v").over(frame), F.lit(0.0))), "s")
    same(got, moves.withColumn("m", F.max("v").over(frame)), "m")


def test_levels_share_one_pass(moves):
    df = moves.withColumn("era", F.floor(F.col("t") / 1000))
    got = scans.prior_levels(
        df, ["k"], {"all_": ["k"], "era_": ["k", "era"]}, ["t", "id"], chunk(), {"n": F.lit(1)}
    )
    same(got, df.withColumn("all_n", F.row_number().over(win()) - 1), "all_n")
    same(got, df.withColumn("era_n", F.row_number().over(W.partitionBy("k", "era").orderBy("t", "id")) - 1), "era_n")


@pytest.mark.parametrize("block", [10, 64, 10**6])
def test_trailing_mean_with_block_halo(moves, block):
    got = scans.trailing_means(moves, ["k"], ["t", "id"], chunk(), "v", {"m3": 3, "m7": 7}, block_rows=block)
    assert got.count() == moves.count()
    for name, n in (("m3", 3), ("m7", 7)):
        same(got, moves.withColumn(name, F.avg("v").over(win().rowsBetween(-n, -1))), name)


def test_global_rank(moves):
    got = scans.global_rank(moves, [F.col("v").desc(), F.col("id")], -F.floor("v"), "r")
    same(got, moves.withColumn("r", F.row_number().over(W.orderBy(F.col("v").desc(), "id"))), "r")


def test_prior_stats_see_only_earlier_rows(moves):
    got = Fe.prior_stats(moves, ["k"], "v", "p", ["t", "id"], chunk())
    before = win().rowsBetween(W.unboundedPreceding, -1)
    want = moves.withColumns(
        {"p_mean": F.avg("v").over(before), "p_std": F.stddev_pop("v").over(before), "p_count": F.count("v").over(before)}
    )
    for name in ("p_mean", "p_std", "p_count"):
        same(got, want, name)
    first = got.where("p_count = 0").collect()
    assert len(first) == 4 and all(r["p_mean"] is None and r["p_std"] is None for r in first)


def test_equal_values_have_zero_spread(spark):
    df = spark.createDataFrame([("a", i, i, 0.1) for i in range(50)], "k string, t long, id long, v double")
    out = Fe.prior_stats(df, ["k"], "v", "p", ["t", "id"], F.col("t")).where("p_count > 0").collect()
    assert {r["p_std"] for r in out} == {0.0}


def test_calendar_lag_is_null_over_gaps(spark):
    rows = [("a", f"2024-01-{d:02d}", d) for d in (1, 2, 4, 8)]
    df = spark.createDataFrame(rows, "k string, d string, x long").withColumn("d", F.col("d").cast("date"))
    out = {r["x"]: r for r in Fe.calendar_lags(df, ["k"], "d", "x", (1, 7)).collect()}
    assert out[2]["lag1_x"] == 1 and out[4]["lag1_x"] is None and out[8]["lag7_x"] == 1
    row = {r["x"]: r["r"] for r in Fe.row_lag(df, ["k"], "d", "x", 1, "r").collect()}
    assert row[4] == 2  # the row lag does not notice the gap


def test_leaking_columns_are_refused():
    with pytest.raises(ValueError, match="actual_headway_min"):
        Fe.check_features(["hour", "actual_headway_min"])
    for names in Fe.FEATURE_PROVENANCE.values():
        Fe.check_features(names)


def test_feature_catalogue(spark):
    got = Fe.feature_catalogue(spark)
    assert {r["provenance"] for r in got.collect()} == {"A", "B", "C"}


def test_null_keys_are_a_group(spark):
    rows = [(k, i, i, float(i)) for k in (None, "a") for i in range(12)]
    df = spark.createDataFrame([(k, t, i if k else i + 100, v) for k, t, i, v in rows], "k string, t long, id long, v double").repartition(3)
    two = F.floor(F.col("t") / 2)
    earlier = win().rowsBetween(W.unboundedPreceding, -1)
    same(scans.previous_values(df, ["k"], ["t", "id"], two, {"p": "v"}), df.withColumn("p", F.lag("v").over(win())), "p")
    got = scans.prior_aggregates(df, ["k"], ["t", "id"], two, sums={"s": F.col("v")}, maxes={"m": F.col("v")})
    same(got, df.withColumn("s", F.coalesce(F.sum("v").over(earlier), F.lit(0.0))), "s")
    same(got, df.withColumn("m", F.max("v").over(earlier)), "m")
    same(scans.trailing_means(df, ["k"], ["t", "id"], two, "v", {"a": 3}), df.withColumn("a", F.avg("v").over(win().rowsBetween(-3, -1))), "a")
    whole = df.withColumn("g", F.avg("v").over(W.partitionBy("k")))
    same(scans.with_group(df, ["k"], F.avg("v").alias("g")), whole, "g")
