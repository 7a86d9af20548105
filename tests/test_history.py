"""The trip history moves stored columns only, once for each kind of key, and is what plain windows say."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise import session
from headwise.functions import scans
from headwise.functions.scans import micros_chunk
from headwise.operators import features as Fe
from headwise.operators import models as Mo
from headwise.plans import frames
from headwise.sources import star

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Trips of a frequent, a missing and a few other vehicles; a route and a vehicle that come twice."""
    rng, to = random.Random(11), str(tmp_path_factory.mktemp("star"))
    events = []
    for i in range(1500):
        at = START + dt.timedelta(minutes=rng.choice([rng.randrange(0, 600), rng.randrange(0, 20000)]), seconds=rng.randrange(60))
        user = None if i % 97 == 0 else 5 if rng.random() < 0.4 else rng.randrange(30)
        value = None if i % 41 == 0 else rng.randrange(0, 12000) / 100
        events.append((i, None if i % 113 == 0 else at, user, rng.choice(["signup", "view", "error"]), value, '{"k": %d}' % rng.randrange(100)))
    tables = {
        "events": (events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "customer": ([(i, 100.0) for i in [*range(25), 7]], "c_custkey long, c_acctbal double"),
        "supplier": ([(i, f"S{i}") for i in [*range(18), 3]], "s_suppkey long, s_name string"),
        "region": ([(i, f"Z{i}") for i in range(5)], "r_regionkey int, r_name string"),
        "part": ([(i, f"P{i}") for i in range(40)], "p_partkey long, p_name string"),
        "orders": ([(i, i % 23, START, "F") for i in range(60)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string"),
        "lineitem": (
            [(i % 60, i % 40, i % 9, i % 7 + 1, 10.0, 100.0, 0.1, 0.02, START) for i in range(200)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{to}/{name}.parquet")
    return to


def history(spark, root, **how):
    return Fe.history_frame(
        star.trip_sources(spark, root), star.trip_columns, star.routes(spark, root), star.vehicles(spark, root), star.trip_calendar(spark, root),
        frames.route_zones(spark, root), star.trip_events(spark, root), micros_chunk("us"), session.materialise, **how,
    )


def rows_of(df, *names):
    return sorted(tuple(-1e9 if v is None else v for v in r) for r in df.select(*[F.col(n).cast("double") for n in names]).collect())


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-9)


def test_rolling_means_with_repeated_keys(spark, root):
    trips = frames.trip_facts(spark, root)  # a trip of the repeated route or vehicle comes twice
    before = W.partitionBy("route_id").orderBy("us", "trip_id")
    want = trips.select("trip_id", *[F.avg("departure_delay_min").over(before.rowsBetween(-n, -1)).alias(f"r{n}") for n in (7, 28)])
    got = frames.history(spark, root).select("trip_id", *[F.col(f"route_prior_delay_rolling{n}").alias(f"r{n}") for n in (7, 28)])
    same(rows_of(got, "trip_id", "r7", "r28"), rows_of(want, "trip_id", "r7", "r28"))


def test_vehicles_of_many_trips_and_of_few(spark, root):
    names = ("trip_id", "capacity", "vehicle_prior_delay_mean", "vehicle_date_prior_delay_mean", "route_length_km", "headway_pressure")
    few, many, most = (rows_of(history(spark, root, heavy_rows=n), *names) for n in (10_000, 200, 1))
    same(few, many)
    same(few, most)
    assert len(few) > 1500
    once = star.trips_core(spark, root).where("vehicle_id IS NULL OR vehicle_id NOT IN (7) AND route_id NOT IN (3)")

    def mean(*keys):  # a trip without a delay counts
        w = W.partitionBy(*keys).orderBy("us", "trip_id").rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("departure_delay_min").over(w), F.lit(0)) / F.nullif(F.count(F.lit(1)).over(w), F.lit(0))

    want = once.select("trip_id", mean("vehicle_id").alias("ever"), mean("vehicle_id", "date").alias("day"))
    got = history(spark, root, heavy_rows=200).join(want.select("trip_id"), "trip_id", "left_semi")
    same(rows_of(got, *names[:1], *names[2:4]), rows_of(want, "trip_id", "ever", "day"))


def test_the_last_pass_moves_stored_columns_once(spark, root):
    plan = frames.history(spark, root)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "_chunk" in moved[0], moved  # before: every pass and every join moved all columns


def test_tails_reach_over_short_chunks(spark):
    df = spark.createDataFrame([("a", t, t // 3) for t in range(12)] + [(None, 5, 1), (None, 9, 3)], f"k string, t long, {scans.CHUNK} long")
    got = scans.tails_before(df, ["k"], ["t"], 4, session.materialise).collect()
    of = {(k, c): sorted(r.t for r in got if (r.k, r[scans.CHUNK]) == (k, c)) for k, c in {(r.k, r[scans.CHUNK]) for r in got}}
    assert of == {("a", 1): [0, 1, 2], ("a", 2): [2, 3, 4, 5], ("a", 3): [5, 6, 7, 8], (None, 3): [5]}


def test_scratch_tables_end_with_their_context(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    before = spark.conf.get(session._FREE, None)
    with session.scratch(spark) as keep:
        assert keep(spark.range(3), "three").count() == 3 and len(os.listdir(tmp_path)) == 1
    assert os.listdir(tmp_path) == []
    with session.freed_shuffles(spark), session.freed_shuffles(spark):
        assert spark.conf.get(session._FREE) == "true"
    assert spark.conf.get(session._FREE, None) == before


def test_many_rows_are_fitted_one_by_one(spark):
    assert Mo.fits_at_once(spark.range(1000), ["x"]) == 4
    assert Mo.fits_at_once(spark.range(10**9), ["x"]) == 1


def test_the_sweep_holds_one_fold_at_a_time(spark):
    from contextlib import contextmanager

    open_now, seen = [], []

    class Fold(tuple):
        @contextmanager
        def held(self):
            open_now.append(1)
            seen.append(len(open_now))
            yield self
            open_now.pop()

    x = spark.range(300).select((F.col("id") % 3).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("target"))
    some = [Mo.Candidate("random_forest", {"numTrees": n, "maxDepth": 2}) for n in (2, 3)]
    out = Mo.sweep([Fold((x, x)) for _ in range(3)], ["x"], ("a", "b"), some, top=1)
    assert seen == [1, 1, 1] and [r[4] for r in out].count(2) == 1 and out[0][1] > 0.6


def test_repeats_of_the_importance_are_moved_one_by_one(spark, monkeypatch):
    moved, pair = [], Mo.with_donors
    monkeypatch.setattr(Mo, "with_donors", lambda df, key, repeats, *more: moved.append(list(repeats)) or pair(df, key, repeats, *more))
    df = spark.range(200).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") < 90, "a").otherwise("b").alias("target"))
    model = Mo.fit_classifier(df, ["x"], ("a", "b"), Mo.Candidate("random_forest", {"numTrees": 3, "maxDepth": 3}))
    assert Mo.permutation_importance(model, df, "id", ["x"], repeats=3)[0][1] > 0.1 and moved == [[0], [1], [2]]
    alone = pair(df, "id", [1], 2, "x").select("id", "_donor")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, pair(df, "id", 3, 2, "x").where("_r = 1").select("id", "_donor").collect()))
