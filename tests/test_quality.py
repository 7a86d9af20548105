import pytest

from headwise.operators import quality as V
from headwise.sources import contracts as C
from headwise.sources import store


def vehicles(spark, rows=((("V-1", "standard", 80)), ("V-2", "mini", 45)), schema="vehicle_id string, vehicle_type string, capacity int"):
    return spark.createDataFrame(list(rows), schema)


def test_valid_table(spark):
    r = C.validate_dataset(vehicles(spark), "vehicles")
    assert r.valid and not r.errors and r.schema_info["columns"]["capacity"] == "int"


@pytest.mark.parametrize(
    "rows, schema, message",
    [
        ([("V-1", "standard")], "vehicle_id string, vehicle_type string", "Missing required column: capacity"),
        ([("V-1", "tram", 80)], None, "Invalid category values in vehicle_type: tram"),
        ([("V-1", "mini", 900)], None, "capacity: 1 values above 400"),
        ([("V-1", "mini", 0)], None, "capacity: 1 values below 1"),
        ([("V-1", "mini", 45), ("V-1", "mini", 45)], None, "Primary key vehicle_id is not unique"),
    ],
)
def test_broken_tables(spark, rows, schema, message):
    df = vehicles(spark, rows, schema) if schema else vehicles(spark, rows)
    r = C.validate_dataset(df, "vehicles")
    assert not r.valid and any(message in e for e in r.errors)


def test_unknown_table_and_strict_mode(spark):
    assert C.validate_dataset(vehicles(spark), "trams").errors == ["Unknown dataset: trams"]
    extra = vehicles(spark, [("V-1", "mini", 45, 1)], "vehicle_id string, vehicle_type string, capacity int, extra int")
    assert C.validate_dataset(extra, "vehicles").valid
    assert C.validate_dataset(extra, "vehicles").warnings == ["Unexpected column: extra"]
    assert not C.validate_dataset(extra, "vehicles", strict=True).valid


def test_type_conformance(spark):
    text = vehicles(spark, [("V-1", "mini", "45")], "vehicle_id string, vehicle_type string, capacity string")
    assert any("capacity: expected integer, found string" in w for w in C.validate_dataset(text, "vehicles").warnings)


@pytest.mark.parametrize("ext", ["parquet", "csv", "json"])
def test_files_by_extension(spark, tmp_path, ext):
    path = f"{tmp_path}/vehicles.{ext}"
    if ext == "json":
        with open(path, "w") as f:
            f.write('[{"vehicle_id": "V-1", "vehicle_type": "mini", "capacity": 45}]')
    else:
        store.write_dataset(vehicles(spark), path)
    assert C.validate_file(spark, path).valid


def test_unreadable_files(spark, tmp_path):
    assert "Unsupported file format" in C.validate_file(spark, f"{tmp_path}/vehicles.txt").errors[0]
    assert "Failed to load" in C.validate_file(spark, f"{tmp_path}/absent.parquet").errors[0]


def test_folder_falls_back_and_reports_missing(spark, tmp_path):
    store.write_dataset(vehicles(spark), f"{tmp_path}/vehicles.csv")
    out = C.validate_folder(spark, str(tmp_path))
    assert set(out) == set(C.CONTRACTS)
    assert out["vehicles"].valid and out["routes"].errors == ["Missing dataset: routes"]


def test_contract_table(spark):
    rows = C.contract_table(spark).collect()
    assert len({r["dataset"] for r in rows}) == 10
    assert not any(r["in_key"] for r in rows if r["dataset"] == "tickets")


def issues(df):
    return {(r["column"], r["rule"]): (r["bad_rows"], r["sample"]) for r in df.collect()}


def test_row_checks_in_one_pass(spark):
    df = spark.createDataFrame(
        [("T-1", 5.0, "clear", "2024-03-01"), ("x", 500.0, "fog", "nope"), (None, None, None, None)],
        "trip_id string, departure_delay_min double, weather string, scheduled_departure string",
    )
    checks = [
        V.id_format("trip_id", r"T-\d+"), V.in_range("departure_delay_min", -15, 120),
        V.in_categories("weather", V.WEATHER), V.in_period("scheduled_departure", *V.PERIOD), V.not_null("trip_id"),
    ]
    got = issues(V.row_issues(df, "trips", checks))
    assert got[("trip_id", "malformed id")] == (1, "x")
    assert got[("departure_delay_min", "out of range")] == (1, "500.0")
    assert got[("weather", "unknown category value")] == (1, "fog")
    assert got[("scheduled_departure", "invalid/out-of-range timestamp")][0] == 2
    assert got[("trip_id", "missing values")][0] == 1


def test_samples_keep_three_values(spark):
    df = spark.createDataFrame([(w,) for w in "edcba" * 50], "weather string")
    assert issues(V.row_issues(df, "d", [V.in_categories("weather", V.WEATHER)]))[("weather", "unknown category value")] == (250, "a, b, c")


def test_reference_and_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int")
    ref = spark.createDataFrame([(1,), (2,)], "k int")
    assert V.reference_issue(df, "t", "k", ref, "k").first()["bad_rows"] == 1
    assert V.duplicate_issue(df, "t", ["k"]).first()["bad_rows"] == 1
    assert V.reference_issue(ref, "t", "k", df, "k").count() == 0


def test_arrivals_must_not_move_backwards(spark):
    s = 1_000_000
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 100 * s), (1, 3, 75 * s), (1, 4, 40 * s), (2, 1, 5 * s)], "trip long, seq int, us long")
    assert V.backwards_issue(df, "t", "trip", "seq", "us").first()["bad_rows"] == 1  # 25 s is tolerated, 35 s is not


def test_layer_reports_absent_and_unreadable(spark, tmp_path):
    store.write_dataset(vehicles(spark, [("V-1", "tram", 80)]), f"{tmp_path}/vehicles.parquet")
    (tmp_path / "routes.parquet").write_text("not parquet")
    out = V.validate_layer(spark, str(tmp_path), ["vehicles", "routes", "stops"])
    rules = {(r["dataset"], r["rule"].split(" (")[0]) for r in out.collect()}
    assert rules == {("vehicles", "unknown category value"), ("routes", "unreadable dataset"), ("stops", "missing dataset")}


def fused_and_apart(spark, monotone=None):
    rows = [(i % 40, f"R-{i % 7}" if i % 9 else None, float(i % 11) - 2, None if i % 5 == 0 else f"V-{i % 6}", "fog" if i % 8 == 0 else "clear") for i in range(400)]
    rows += [(3, "R-1", 5.0, "V-99", "hail")] * 300  # a hot key, a hot unknown value and a check that fails often
    trips = spark.createDataFrame(rows, "trip_id long, route_id string, boardings double, vehicle_id string, weather string")
    tickets = spark.createDataFrame([(i, i % 50, None) for i in range(200)] + [(None, None, None)] * 3, "ticket_id long, trip_id long, fare double")
    vehicles = spark.createDataFrame([("V-0",), ("V-1",), ("V-1",), (None,)], "vehicle_id string")
    rules = {"trips": [V.id_format("route_id", r"R-[0-4]"), V.in_range("boardings", 0, 400), V.in_categories("weather", V.WEATHER)], "tickets": [V.not_null("fare")]}
    refs = {"trips": (("vehicle_id", "vehicles", "vehicle_id"),), "tickets": (("trip_id", "trips", "trip_id"), ("ticket_id", "trips", "trip_id"))}
    references = {"vehicles": vehicles, "trips": trips}
    fused = V.validate_tables({"trips": trips, "tickets": tickets}, references, rules, refs=refs)
    apart = V.all_issues([
        V.row_issues(trips, "trips", rules["trips"]), V.row_issues(tickets, "tickets", rules["tickets"]),
        V.duplicate_issue(trips, "trips", ["trip_id"], "error"), V.duplicate_issue(tickets, "tickets", ["ticket_id"], "error"),
        V.reference_issue(trips, "trips", "vehicle_id", vehicles, "vehicle_id"),
        V.reference_issue(tickets, "tickets", "trip_id", trips, "trip_id"), V.reference_issue(tickets, "tickets", "ticket_id", trips, "trip_id"),
    ])
    return fused, apart


def test_fused_issues_equal_the_separate_operators(spark):
    fused, apart = fused_and_apart(spark)
    assert fused.columns == apart.columns
    got, want = sorted(map(tuple, fused.collect()), key=str), sorted(map(tuple, apart.collect()), key=str)
    assert got == want and len(want) == 9


def test_fused_validation_scans_a_table_once(spark, tmp_path):
    for name, df in {"trips": spark.range(1000).selectExpr("id AS trip_id", "id % 3 AS route_id", "'fog' AS weather"), "routes": spark.range(2).selectExpr("id AS route_id")}.items():
        df.write.parquet(f"{tmp_path}/{name}")
    trips, routes = spark.read.parquet(f"{tmp_path}/trips"), spark.read.parquet(f"{tmp_path}/routes")
    out = V.validate_tables({"trips": trips}, {"routes": routes}, {"trips": [V.in_categories("weather", V.WEATHER)]})
    assert {(r["rule"], r["bad_rows"], r["total_rows"], r["sample"]) for r in out.collect()} == {
        ("unknown category value", 1000, 1000, "fog"), ("unknown reference value", 333, 1000, None)}
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 2 and "ReusedExchange" in final  # trips and routes, once each


@pytest.mark.parametrize(
    "rows, schema, bad",
    [
        ([("a", "bc"), ("ab", "c"), ("1:a", None), (None, "1:a"), (None, "n"), ("n", None)], "trip_id string, seq string", 0),
        ([(0.0, 1), (-0.0, 1), (float("nan"), 1), (float("nan"), 1), (None, 1), (None, 1)], "trip_id double, seq int", 3),
        ([([1], 1), ([1], 1), (None, 1)], "trip_id array<int>, seq int", 1),
    ],
)
def test_keys_that_look_alike(spark, rows, schema, bad):
    df = spark.createDataFrame(rows, schema)
    out = V.validate_tables({"stop_trips": df}, rules={}).collect()
    assert sum(r["bad_rows"] for r in out if r["rule"] == "duplicate records") == bad
    assert V.validate_tables({"stop_trips": df.limit(0)}, rules={}).count() == 0
