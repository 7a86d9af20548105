import math

import pytest
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X
from headwise.operators.metrics import TARGETS


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_hours_map_to_bands(spark):
    hours = [(7,), (9,), (12,), (15,), (17,), (19,), (2,), (22,), (None,)]
    got = values(spark, hours, "h int", X.time_band("h"))
    assert got == ["morning peak"] * 2 + ["midday"] * 2 + ["evening peak"] * 2 + ["night"] * 2 + [None]


def test_severity_buckets_own_their_right_edge(spark):
    delays = [-2.0, 0.0, 4.9, 5.0, 5.1, 8.9, 9.0, 9.1, 15.0, 29.9, 30.0, 30.1, 62.0]
    want = ["on time"] * 4 + ["moderate"] * 3 + ["severe"] * 4 + ["critical"] * 2
    rows = [(d,) for d in delays]
    assert values(spark, rows, "d double", X.delay_severity("d")) == want
    assert values(spark, rows, "d double", TARGETS["severity"].label("d")) == want


def test_binary_status(spark):
    got = values(spark, [(0.0,), (5.0,), (5.1,), (30.0,)], "d double", TARGETS["delay_status"].label("d"))
    assert got == ["on time", "on time", "delayed", "delayed"]


def test_clip_keeps_nulls(spark):
    assert values(spark, [(-1.0,), (50.0,), (300.0,), (None,)], "x double", X.clip100("x")) == [0.0, 50.0, 100.0, None]


def test_safe_division(spark):
    assert values(spark, [(1.0, 0.0), (1.0, 4.0)], "a double, b double", X.ratio("a", "b")) == [None, 0.25]


def test_cyclical_pair_is_on_the_circle(spark):
    df = spark.createDataFrame([(6,)], "h int").select(*X.cyclical("h", 24, "hour"))
    s, c = df.first()
    assert math.isclose(s, 1.0) and abs(c) < 1e-12


def test_weighted_score_clamps_and_ignores_unknown_names(spark):
    score = X.weighted_score({"demand": F.lit(150.0), "other": F.lit(99.0)}, S.SCORE_WEIGHTS)
    assert values(spark, [(1,)], "x int", score) == [pytest.approx(20.0)]
    assert sum(S.SCORE_WEIGHTS.values()) == pytest.approx(1.0)


def test_class_bands(spark):
    got = values(spark, [(80.0,), (79.9,), (65.0,), (50.0,), (0.0,)], "s double", X.score_class("s"))
    assert got == ["Top Performer", "Solid", "Solid", "Needs Attention", "Action Required"]


def test_labels_become_keys(spark):
    assert values(spark, [(" Route Info ",), ("travel-time",)], "s string", X.canonical_key("s")) == ["route_info", "travel_time"]
