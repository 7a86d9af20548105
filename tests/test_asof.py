"""As-of joins and equi-depth chunks against plain Python, with hot keys, ties and nulls."""

import random

from pyspark.sql import functions as F

from headwise.functions import scans
from headwise.functions.asof import last_match
from headwise.operators import aggregates as A


def expected(left, right, strict, tolerance):
    out = []
    for i, k, at in left:
        found = [(t, v) for rk, t, v in right if rk == k and t is not None and at is not None and (t < at or (t == at and not strict))]
        best = max(found, key=lambda r: (r[0], r[1] is not None, r[1] or 0), default=None)
        if best is not None and tolerance is not None and at - best[0] > tolerance:
            best = None
        out.append((i, k, at, *(best or (None, None))))
    return sorted(out, key=repr)


def test_last_match_with_hot_and_null_keys(spark):
    random_ = random.Random(5)
    key = lambda: random_.choice(["hot"] * 8 + ["b", "c", None])
    left = [(i, key(), random_.choice([None, *range(60)])) for i in range(400)]
    right = [(key(), random_.choice([None, *range(0, 60, 3)]), random_.choice([None, *range(5)])) for _ in range(120)]
    a = spark.createDataFrame(left, "id int, k string, at int").repartition(5)
    b = spark.createDataFrame(right, "k string, t int, v int").repartition(3)
    for strict in (False, True):
        for tolerance in (None, 4):
            got = last_match(a, b, ["k"], "at", "t", {"t": "t", "v": "v"}, strict, tolerance)
            assert got.columns == ["id", "k", "at", "t", "v"]
            assert sorted(map(tuple, got.collect()), key=repr) == expected(left, right, strict, tolerance)
    assert last_match(a, b.limit(0), ["k"], "at", "t", {"v": "v"}).where("v IS NULL").count() == 400
    assert last_match(a.limit(0), b, ["k"], "at", "t", {"v": "v"}).count() == 0
    whole = last_match(a, b, [], "at", "t", {"t": "t", "v": "v"})
    anyone = expected([(i, 0, at) for i, _, at in left], [(0, t, v) for _, t, v in right], False, None)
    assert sorted((r.id, r.t, r.v) for r in whole.collect() if r.t is not None) == sorted((r[0], r[3], r[4]) for r in anyone if r[3] is not None)


def test_equi_depth_splits_a_busy_hour_and_ties(spark):
    rows = [(i, "hot" if i % 10 else "other", 3_600_000_000 * 7 if i % 3 else i * 1000, float(i % 13)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, k string, us long, v double")
    chunked = scans.equi_depth(df, ["k", "us", "id"], 16)
    sizes = [r["count"] for r in chunked.groupBy(scans.CHUNK).count().collect()]
    by_hour = df.groupBy("k", scans.micros_chunk("us").alias("h")).count().agg(F.max("count")).first()[0]
    assert sum(sizes) == 4000 and max(sizes) <= 3 * 4000 / 16 < by_hour
    got = scans.prior_aggregates(chunked, ["k"], ["us", "id"], F.col(scans.CHUNK), sums={"s": F.col("v")}, maxes={"m": F.col("v")})
    want, state = {}, {}
    for i, k, us, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s, m = state.get(k, (0.0, None))
        want[i] = (s, m)
        state[k] = (s + v, v if m is None else max(m, v))
    assert {r.id: (r.s, r.m) for r in got.collect()} == want
    before = scans.previous_values(chunked, ["k"], ["us", "id"], F.col(scans.CHUNK), {"p": "id"})
    last, prev = {}, {}
    for i, k, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        prev[i], last[k] = last.get(k), i
    assert {r.id: r.p for r in before.collect()} == prev


def test_levels_tell_null_keys_from_left_out_ones(spark):
    rides = spark.createDataFrame([("r", "a", None), ("r", None, "x"), (None, "a", None), ("r", "a", None)], "route string, o string, d string")
    levels = {"pair": ("o", "d"), "route_pair": ("route", "o", "d")}
    out = A.od_levels(rides, levels)
    got = sorted(((r.level, r.route, r.o, r.d, r.passengers) for r in out.collect()), key=repr)
    assert got == sorted([("pair", None, "a", None, 3), ("pair", None, None, "x", 1), ("route_pair", "r", "a", None, 2), ("route_pair", "r", None, "x", 1), ("route_pair", None, "a", None, 1)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "Union" not in plan  # one scan for all levels
