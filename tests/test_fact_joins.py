"""Joins of visits and rides with their trips and stops: rows on keys that repeat, miss or match nothing, and the columns that are moved."""

from collections import Counter
from datetime import date, datetime

import pytest

from headwise.plans.catalog import load

DAY = datetime(2024, 1, 3)
#: order, line, part, supplier, quantity, price, discount, tax, ship date
LINES = [
    (1, 1, 10, 11, 9.0, 5000.0, 0.1, 0.0, DAY),
    (1, 1, 10, 11, 9.0, 5000.0, 0.1, 0.0, DAY),
    (1, 2, 99, 10, 18.0, 2500.0, 0.0, 0.1, DAY),
    (2, 1, 11, 99, 45.0, 100.0, None, 0.1, DAY),
    (2, None, 12, None, 4.5, 100.0, 0.0, 0.1, DAY),
    (3, 5, 12, 12, None, 100.0, 0.0, 0.1, DAY),
    (3, 7, None, 12, 1.0, None, 0.0, None, None),
    (None, 3, 11, 11, 1.0, 100.0, 0.0, 0.0, DAY),
    (8, 3, 11, 11, 1.0, 100.0, 0.0, 0.0, DAY),
]
ORDERS = [(1, 21, "F", DAY), (2, 42, "O", None), (3, 5, "O", DAY), (3, 6, "P", DAY), (None, 7, "F", DAY)]
PARTS = [(10, "a"), (11, None), (12, "c"), (12, "d"), (None, "e")]
ZONES = {0: "north", 1: "south"}  # none for key 2


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("facts"))
    lines = (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_shipdate timestamp_ntz"
    )
    for name, rows, schema in (
        ("lineitem", LINES, lines),
        ("orders", ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"),
        ("part", PARTS, "p_partkey long, p_name string"),
        ("region", list(ZONES.items()), "r_regionkey int, r_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def trips(key):
    return [(c % 20, d and str(d.date())) for k, c, _, d in ORDERS if k is not None and k == key] or [(None, None)]


def places(key):
    return [(n, ZONES.get(k % 5)) for k, n in PARTS if k is not None and k == key] or [(None, None)]


def band(hour):
    return None if hour is None else load_band(hour)


def load_band(hour):
    from headwise import settings as S

    return S.TIME_BAND_LABELS[sum(hour >= e for e in S.TIME_BAND_EDGES)]


def times(a, b):
    return None if a is None or b is None else a * b


def expected_facts():
    out = []
    for trip, seq, stop, ref, q, price, discount, tax, day in LINES:
        hour = times(seq, 3)
        own = (
            stop, trip, seq, hour, q, times(q, None if discount is None else 1 - 5 * discount), None if price is None else price / 5000 - 5,
            None if q is None else 25 + 2.5 * q, None if q is None else q / 45, q, ref, tax, day and str(date(day.year, day.month, day.day)), band(hour),
        )
        out += [own + t + p for t in trips(trip) for p in places(stop)]
    return out


def widest_exchange(df):
    """Columns of the widest shuffle of the plan, as planned without broadcasts."""
    spark = df.sparkSession
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        todo, widest = [df.select("*")._jdf.queryExecution().executedPlan()], 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            widest = max(widest, node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return widest


def test_stop_facts_move_stored_columns_only(spark, root):
    out = load()["J04_stop_facts"].build(spark, root)
    assert out.columns == [
        "stop_id", "trip_id", "seq", "hour", "boarded", "alighted", "arr_delay_min", "dwell_sec", "occupancy_after", "onboard_after", "visit_ref", "tax",
        "ship_date", "time_band", "route_id", "date", "stop_name", "zone",
    ]
    assert Counter(map(tuple, out.collect())) == Counter(expected_facts())
    assert widest_exchange(out) <= 11


def test_row_guard_moves_a_flag(spark, root):
    out = load()["J02_join_row_guard"].build(spark, root)
    facts = expected_facts()
    groups = Counter((f[1], f[2]) for f in facts)
    want = (len(LINES), len(facts), len(facts) - len(groups), sum(None in f for f in facts))
    assert tuple(out.first()) == want and 0 < want[3] < want[1]
    assert widest_exchange(out) <= 4


def test_passenger_flow_moves_the_trip_context_last(spark, root):
    out = load()["J05_passenger_flow"].build(spark, root)
    assert out.columns == ["alight_stop", "board_stop", "trip_id", "fare", "route_id", "date", "boarding_zone", "alighting_zone"]
    want = Counter(
        (ref, stop, trip, price, *t, b[1], a[1])
        for trip, _, stop, ref, _, price, *_ in LINES for t in trips(trip) for b in places(stop) for a in places(ref)
    )
    assert Counter(map(tuple, out.collect())) == want
    assert widest_exchange(out) <= 6
