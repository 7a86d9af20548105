"""Data quality (V) and cleaning (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwise.operators import cleaning as C
from headwise.operators import quality as V
from headwise.plans import oracle_raw  # noqa: F401  (registers the raw views)
from headwise.plans.catalog import query
from headwise.session import materialise
from headwise.sources import contracts, star

SAMPLE = "(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {v} AS v FROM {t} WHERE {bad} AND {v} IS NOT NULL ORDER BY 1 LIMIT 3))"


def issue(dataset: str, column: str, rule: str, severity: str, table: str, bad: str, shown: str) -> str:
    sample = SAMPLE.format(v=shown, t=table, bad=bad)
    return f"""SELECT '{dataset}' AS dataset, '{column}' AS "column", '{rule}' AS rule, '{severity}' AS severity, bad_rows, total_rows, CAST({sample} AS VARCHAR) AS sample
    FROM (SELECT count(*) FILTER (WHERE {bad}) AS bad_rows, count(*) AS total_rows FROM {table}) WHERE bad_rows > 0"""


def dup_issue(dataset: str, keys: str, table: str, severity: str = "warning") -> str:
    shown = keys.replace(", ", "+")
    return f"""SELECT '{dataset}' AS dataset, '{shown}' AS "column", 'duplicate records' AS rule, '{severity}' AS severity, bad_rows, total_rows, CAST(NULL AS VARCHAR) AS sample
    FROM (SELECT CAST(sum(n - 1) AS BIGINT) AS bad_rows, CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})) WHERE bad_rows > 0"""


def ref_issue(dataset: str, column: str, table: str, reference: str, ref_column: str, severity: str = "error") -> str:
    return f"""SELECT '{dataset}' AS dataset, '{column}' AS "column", 'unknown reference value' AS rule, '{severity}' AS severity, bad_rows, total_rows, CAST(NULL AS VARCHAR) AS sample
    FROM (SELECT count(*) FILTER (WHERE {column} IS NOT NULL AND CAST({column} AS VARCHAR) NOT IN (SELECT CAST({ref_column} AS VARCHAR) FROM {reference})) AS bad_rows, count(*) AS total_rows FROM {table})
    WHERE bad_rows > 0"""


_NULL = issue("vehicles", "capacity", "missing values", "warning", "raw_vehicles", "capacity IS NULL", "CAST(NULL AS VARCHAR)")
_RANGE = issue("vehicles", "capacity", "impossible capacity", "error", "raw_vehicles", "(capacity IS NULL OR capacity < 1 OR capacity > 400)", "CAST(CAST(capacity AS DOUBLE) AS VARCHAR)")
_ID = issue("trips", "route_id", "malformed id", "error", "raw_trips", "NOT regexp_matches(route_id, '^R-[0-9]+')", "route_id")
_CATEGORY = issue("trips", "weather", "unknown category value", "warning", "raw_trips", "weather NOT IN ('clear', 'rain', 'snow', 'storm')", "weather")
_PERIOD = issue(
    "trips", "scheduled_departure", "invalid/out-of-range timestamp", "warning", "raw_trips",
    "coalesce(NOT (try_cast(scheduled_departure AS TIMESTAMP) BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '2000-01-01'), true)", "scheduled_departure",
)
_ORDER = issue(
    "tickets", "boarding_datetime > alighting_datetime", "chronology violation", "error", "raw_tickets",
    "coalesce(try_cast(alighting_datetime AS TIMESTAMP) < try_cast(boarding_datetime AS TIMESTAMP), false)", "alighting_datetime",
)
_MONOTONE = """SELECT 'stop_trips' AS dataset, 'actual_arrival' AS "column", 'arrival time moves backwards' AS rule, 'error' AS severity, bad_rows, total_rows, CAST(NULL AS VARCHAR) AS sample
FROM (SELECT count(*) FILTER (WHERE us < prev - 30000000) AS bad_rows, count(*) AS total_rows FROM (SELECT us, lag(us) OVER (PARTITION BY trip_id ORDER BY seq, us) AS prev FROM (
SELECT l_orderkey AS trip_id, l_linenumber AS seq, epoch_us(l_shipdate) AS us FROM lineitem))) WHERE bad_rows > 0"""


@query("V01_null_counts", _NULL)
def _(spark, root):
    return V.row_issues(star.raw_vehicles(spark, root), "vehicles", [V.not_null("capacity"), V.not_null("vehicle_type", "error")])


@query("V02_duplicate_rows", dup_issue("stop_trips", "trip_id, seq", "raw_stop_visits"))
def _(spark, root):
    return V.duplicate_issue(star.raw_stop_visits(spark, root), "stop_trips", ["trip_id", "seq"])


@query("V03_id_format", _ID)
def _(spark, root):
    return V.row_issues(star.raw_trips(spark, root), "trips", [V.id_format("route_id", r"R-\d+")])


@query("V04_numeric_range", _RANGE)
def _(spark, root):
    check = V.in_range("capacity", 1, 400, allow_null=False, label="impossible capacity")
    return V.row_issues(star.raw_vehicles(spark, root), "vehicles", [check])


@query("V05_allowed_categories", _CATEGORY)
def _(spark, root):
    return V.row_issues(star.raw_trips(spark, root), "trips", [V.in_categories("weather", V.WEATHER)])


@query("V06_timestamp_window", _PERIOD)
def _(spark, root):
    return V.row_issues(star.raw_trips(spark, root), "trips", [V.in_period("scheduled_departure", "1994-01-01", "2000-01-01")])


@query("V07_chronology", _ORDER)
def _(spark, root):
    return V.row_issues(star.raw_tickets(spark, root), "tickets", [V.in_order("boarding_datetime", "alighting_datetime")])


@query("V08_reference_check", ref_issue("tickets", "trip_id", "raw_tickets", "valid_trips", "trip_id"))
def _(spark, root):
    return V.reference_issue(star.raw_tickets(spark, root), "tickets", "trip_id", star.valid_trips(spark, root), "trip_id")




@query(
    "V09_two_columns_one_dimension",
    " UNION ALL ".join(
        ref_issue("tickets", c, "(SELECT l_partkey AS boarding_stop_id, l_suppkey AS alighting_stop_id FROM lineitem)", "(SELECT DISTINCT c_custkey FROM customer)", "c_custkey")
        for c in ("boarding_stop_id", "alighting_stop_id")
    ),
)
def _(spark, root):
    ends = star.table(spark, root, "lineitem").select(F.col("l_partkey").alias("boarding_stop_id"), F.col("l_suppkey").alias("alighting_stop_id"))
    dim = star.table(spark, root, "customer")
    return V.all_issues([V.reference_issue(ends, "tickets", c, dim, "c_custkey") for c in ends.columns])


def _clocked(spark, root):
    return star.table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq"), star.clock_us("l_shipdate").alias("us")
    )


@query("V10_monotone_arrivals", _MONOTONE)
def _(spark, root):
    return V.backwards_issue(_clocked(spark, root), "stop_trips", "trip_id", "seq", "us")


_LAYER = " UNION ALL ".join(
    [
        _ID, _CATEGORY, _PERIOD, _RANGE, _ORDER, dup_issue("trips", "trip_id", "raw_trips", "error"), dup_issue("tickets", "ticket_id", "raw_tickets", "error"),
        ref_issue("tickets", "trip_id", "raw_tickets", "valid_trips", "trip_id"), ref_issue("trips", "vehicle_id", "raw_trips", "vehicles", "vehicle_id"),
        issue("tickets", "fare", "invalid fare", "error", "raw_tickets", "(try_cast(fare AS DOUBLE) < 0.1e0 OR try_cast(fare AS DOUBLE) > 1000)", "CAST(try_cast(fare AS DOUBLE) AS VARCHAR)"),
        issue("tickets", "pass_type", "unknown category value", "warning", "raw_tickets", "pass_type NOT IN ('single', 'day', 'weekly', 'monthly')", "pass_type"),
    ]
)


def _layer_issues(spark, root):
    rules = {
        "trips": [
            V.id_format("route_id", r"R-\d+"), V.in_categories("weather", V.WEATHER), V.in_period("scheduled_departure", "1994-01-01", "2000-01-01"),
        ],
        "vehicles": [V.in_range("capacity", 1, 400, allow_null=False, label="impossible capacity")],
        "tickets": [
            V.in_order("boarding_datetime", "alighting_datetime"), V.in_range("fare", 0.1, 1000, label="invalid fare"),
            V.in_categories("pass_type", V.PASS_TYPES), V.in_range("distance_km", -1e9, 1e9),
        ],
    }
    frames = {"trips": star.raw_trips(spark, root), "vehicles": star.raw_vehicles(spark, root), "tickets": star.raw_tickets(spark, root)}
    references = {"trips": star.valid_trips(spark, root), "vehicles": star.vehicles(spark, root)}
    refs = {"tickets": (("trip_id", "trips", "trip_id"),), "trips": (("vehicle_id", "vehicles", "vehicle_id"),)}
    return V.validate_tables(frames, references, rules, refs=refs)


@query("V11_validate_layer", _LAYER)
def _(spark, root):
    return _layer_issues(spark, root)


@query("V12_issues_by_severity", f"SELECT severity, count(*) AS issues FROM ({_LAYER}) GROUP BY 1")
def _(spark, root):
    return V.severity_summary(_layer_issues(spark, root))


@query("V14_primary_key_uniqueness", "SELECT trip_id, seq, count(*) AS count FROM raw_stop_visits GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, root):
    return contracts.duplicate_keys(star.raw_stop_visits(spark, root), ["trip_id", "seq"])


@query(
    "V16_invalid_category_values",
    "SELECT weather AS value, count(*) AS count FROM raw_trips WHERE weather NOT IN ('clear', 'rain', 'snow', 'storm') GROUP BY 1 ORDER BY 1 LIMIT 5",
)
def _(spark, root):
    return contracts.invalid_values(star.raw_trips(spark, root), "weather", V.WEATHER)


@query(
    "V17_below_above_bounds",
    """SELECT 'boardings' AS "column", count(*) FILTER (WHERE boardings < 0) AS below, count(*) FILTER (WHERE boardings > 400) AS above FROM raw_trips UNION ALL
    SELECT 'departure_delay_min', count(*) FILTER (WHERE try_cast(departure_delay_min AS DOUBLE) < -15), count(*) FILTER (WHERE try_cast(departure_delay_min AS DOUBLE) > 120) FROM raw_trips UNION ALL
    SELECT 'occupancy_max_pct', count(*) FILTER (WHERE occupancy_max_pct < 0), count(*) FILTER (WHERE occupancy_max_pct > 200) FROM raw_trips""",
)
def _(spark, root):
    bounds = {c: contracts.CONTRACTS["trips"].bounds[c] for c in ("boardings", "departure_delay_min", "occupancy_max_pct")}
    return contracts.bound_counts(star.raw_trips(spark, root), bounds)


# Cleaning -------------------------------------------------------------------------------------------------------


def _named(spark, root):
    return C.canonical_ids(star.raw_trips(spark, root), "route_id", star.route_names(spark, root), "route_id")


@query("C01_keep_first_copy", "SELECT trip_id, seat_ref, distance_km, route_id FROM trips_first")
def _(spark, root):
    return C.keep_first(_named(spark, root), ["trip_id"], star.TRIP_ORDER).select("trip_id", "seat_ref", "distance_km", "route_id")


@query("C02_canonical_ids", "SELECT route_id, count(*) AS n, sum(distance_km) AS km FROM trips_named GROUP BY 1")
def _(spark, root):
    return _named(spark, root).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.sum("distance_km").alias("km"))


@query(
    "C03_lenient_timestamps",
    "SELECT trip_id, seat_ref, CAST(try_cast(scheduled_departure AS TIMESTAMP) AS VARCHAR) AS scheduled_departure, CAST(try_cast(actual_departure AS TIMESTAMP) AS VARCHAR) AS actual_departure FROM raw_trips",
)
def _(spark, root):
    out = C.lenient_times(star.raw_trips(spark, root), ["scheduled_departure", "actual_departure"])
    return out.select("trip_id", "seat_ref", "scheduled_departure", "actual_departure")


_FIXED = """CASE weather WHEN 'rainy' THEN 'rain' WHEN 'clearr' THEN 'clear' WHEN 'thunderstorm' THEN 'storm' ELSE weather END AS weather,
CASE day_type WHEN 'wknd' THEN 'weekend' WHEN 'holliday' THEN 'holiday' ELSE day_type END AS day_type"""


@query("C04_category_typos", f"SELECT weather, day_type, count(*) AS n FROM (SELECT {_FIXED} FROM raw_trips) GROUP BY 1, 2")
def _(spark, root):
    out = C.fix_categories(star.raw_trips(spark, root), ["weather", "day_type"])
    return out.groupBy("weather", "day_type").agg(F.count(F.lit(1)).alias("n"))


@query("C05_category_default", "SELECT trip_id, seat_ref, CASE WHEN weather IN ('clear', 'rain', 'snow', 'storm') THEN weather ELSE 'clear' END AS weather FROM raw_trips")
def _(spark, root):
    return star.raw_trips(spark, root).select("trip_id", "seat_ref", C.or_default("weather", V.WEATHER, "clear").alias("weather"))


@query(
    "C06_drop_unknown_parent",
    """SELECT count(*) FILTER (WHERE trip_id IN (SELECT trip_id FROM valid_trips)) AS kept, count(*) FILTER (WHERE trip_id NOT IN (SELECT trip_id FROM valid_trips)) AS dropped FROM raw_tickets""",
)
def _(spark, root):
    tickets, trips = star.raw_tickets(spark, root), star.valid_trips(spark, root)
    dropped = C.unknown_rows(tickets, "trip_id", trips, "trip_id").agg(F.count(F.lit(1))).scalar()
    kept = C.known_only(tickets, "trip_id", trips, "trip_id").agg(F.count(F.lit(1)).alias("kept"))
    return kept.select("kept", dropped.alias("dropped"))


def _kept_trips(spark, root):
    df = C.keep_first(_named(spark, root), ["trip_id"], star.TRIP_ORDER)
    df = C.drop_missing(C.lenient_times(df, ["scheduled_departure"]), ["scheduled_departure"])
    return C.known_only(df, "route_id", star.route_names(spark, root), "route_id")


@query("C07_repair_key_from_pool", "SELECT trip_id, route_id, vehicle_id FROM trips_vehicled")
def _(spark, root):
    out = C.repair_from_pool(
        _kept_trips(spark, root), "vehicle_id", star.vehicles(spark, root), "route_id", star.vehicle_pools(spark, root), "pool_order"
    )
    return out.select("trip_id", "route_id", "vehicle_id")


@query("C08_lookup_fallback_chain", "SELECT r.trip_id, r.seat_ref, coalesce(v.capacity, 80) AS capacity FROM raw_trips r LEFT JOIN vehicles v ON r.vehicle_id = v.vehicle_id")
def _(spark, root):
    out = C.lookup_chain(star.raw_trips(spark, root), "vehicle_id", star.vehicles(spark, root), "capacity", 80)
    return out.select("trip_id", "seat_ref", "capacity")


@query("C09_text_to_number", "SELECT trip_id, seat_ref, distance_km, try_cast(departure_delay_min AS DOUBLE) AS departure_delay_min FROM raw_trips")
def _(spark, root):
    out = C.to_numbers(star.raw_trips(spark, root), ["departure_delay_min"])
    return out.select("trip_id", "seat_ref", "distance_km", "departure_delay_min")


@query(
    "C10_impute_column_median",
    """WITH n AS (SELECT trip_id, seat_ref, distance_km, try_cast(departure_delay_min AS DOUBLE) AS d FROM raw_trips)
    SELECT trip_id, seat_ref, distance_km, coalesce(d, (SELECT quantile_cont(d, 0.5) FROM n)) AS departure_delay_min FROM n""",
)
def _(spark, root):
    out = C.impute_median(C.to_numbers(star.raw_trips(spark, root), ["departure_delay_min"]), "departure_delay_min")
    return out.select("trip_id", "seat_ref", "distance_km", "departure_delay_min")


@query(
    "C11_impute_group_median",
    """SELECT trip_id, seat_ref, distance_km, t.route_id, coalesce(occupancy_max_pct, m.med, 0) AS occupancy_max_pct FROM trips_named t
    LEFT JOIN (SELECT route_id, quantile_cont(occupancy_max_pct, 0.5) AS med FROM trips_named GROUP BY 1) m ON t.route_id = m.route_id""",
)
def _(spark, root):
    out = C.impute_group_median(_named(spark, root), ["route_id"], "occupancy_max_pct", 0.0)
    return out.select("trip_id", "seat_ref", "distance_km", "route_id", "occupancy_max_pct")


@query(
    "C12_impute_birth_year",
    """SELECT p.passenger_id, CAST(trunc(coalesce(birth_year, m.med)) AS INTEGER) AS birth_year, CAST(greatest(least(coalesce(try_cast(annual_trips AS DOUBLE), 1), 400), 1) AS INTEGER) AS annual_trips
    FROM passengers p LEFT JOIN (SELECT age_group, quantile_cont(birth_year, 0.5) AS med FROM passengers GROUP BY 1) m ON p.age_group = m.age_group""",
)
def _(spark, root):
    return C.clean_passengers(star.passengers(spark, root)).select("passenger_id", "birth_year", "annual_trips")


@query("C13_clip_to_bounds", "SELECT trip_id, seat_ref, greatest(least(boardings, 400), 0) AS boardings, greatest(least(alightings, 400), 0) AS alightings FROM raw_trips")
def _(spark, root):
    t = star.raw_trips(spark, root)
    return t.select("trip_id", "seat_ref", C.clip_round("boardings", 0.0, 400.0).alias("boardings"), C.clip_round("alightings", 0.0, 400.0).alias("alightings"))


@query("C14_default_by_type", "SELECT vehicle_id, vehicle_type, CASE WHEN capacity > 0 THEN capacity ELSE CASE vehicle_type WHEN 'standard' THEN 80 WHEN 'articulated' THEN 130 ELSE 45 END END AS capacity FROM raw_vehicles")
def _(spark, root):
    return C.clean_vehicles(star.raw_vehicles(spark, root)).select("vehicle_id", "vehicle_type", "capacity")


@query("C15_drop_missing_required", "SELECT ticket_id, part_ref, passenger_id FROM raw_tickets WHERE passenger_id IS NOT NULL")
def _(spark, root):
    return C.drop_missing(star.raw_tickets(spark, root), ["passenger_id"]).select("ticket_id", "part_ref", "passenger_id")


@query(
    "C16_fill_time_from_other",
    """SELECT trip_id, seq, visit_ref, CAST(a AS VARCHAR) AS actual_arrival FROM (SELECT *, coalesce(try_cast(actual_arrival AS TIMESTAMP), try_cast(scheduled_arrival AS TIMESTAMP)) AS a FROM raw_visits) WHERE a IS NOT NULL""",
)
def _(spark, root):
    v = C.lenient_times(star.raw_visits(spark, root), ["scheduled_arrival", "actual_arrival"])
    return C.fill_time(v, "actual_arrival", "scheduled_arrival").select("trip_id", "seq", "visit_ref", "actual_arrival")


@query(
    "C17_drop_impossible_intervals",
    "SELECT ticket_id, part_ref FROM raw_tickets WHERE try_cast(alighting_datetime AS TIMESTAMP) > try_cast(boarding_datetime AS TIMESTAMP)",
)
def _(spark, root):
    t = C.lenient_times(star.raw_tickets(spark, root), ["boarding_datetime", "alighting_datetime"])
    return C.positive_intervals(t, "boarding_datetime", "alighting_datetime").select("ticket_id", "part_ref")


@query(
    "C18_overwrite_from_parent",
    "SELECT k.ticket_id, k.part_ref, coalesce(t.route_id, k.route_id) AS route_id, coalesce(t.route_id <> k.route_id, false) AS changed FROM raw_tickets k LEFT JOIN valid_trips t ON k.trip_id = t.trip_id",
)
def _(spark, root):
    out = C.from_parent(star.raw_tickets(spark, root), "trip_id", star.valid_trips(spark, root), "route_id")
    return out.select("ticket_id", "part_ref", "route_id", F.col("_changed").alias("changed"))


@query(
    "C19_recompute_fare",
    """SELECT ticket_id, part_ref, coalesce(try_cast(fare AS DOUBLE), (18 + 4.2e0*try_cast(distance_km AS DOUBLE))*CASE pass_type WHEN 'day' THEN 0.75e0 WHEN 'weekly' THEN 0.5e0 WHEN 'monthly' THEN 0.35e0 ELSE 1e0 END) AS fare FROM raw_tickets""",
)
def _(spark, root):
    t = C.to_numbers(star.raw_tickets(spark, root), ["fare", "distance_km"])
    return t.select("ticket_id", "part_ref", C.recomputed_fare("fare", "distance_km", "pass_type").alias("fare"))


@query("C20_running_balance", "SELECT trip_id, seq, onboard_after FROM visits_balanced")
def _(spark, root):
    out = C.clean_stop_visits(star.raw_visits(spark, root), star.stop_names(spark, root), star.valid_trips(spark, root), star.VISIT_ORDER, digits=None)
    return out.select("trip_id", "seq", "onboard_after")


@query(
    "C21_reconcile_with_children",
    """SELECT t.trip_id, coalesce(c.a, 0) AS occupancy_avg_pct, coalesce(c.m, 0) AS occupancy_max_pct FROM order_trips t
    LEFT JOIN (SELECT trip_id, avg(occupancy_after)*100 AS a, max(occupancy_after)*100 AS m FROM raw_stop_visits GROUP BY 1) c ON t.trip_id = c.trip_id""",
)
def _(spark, root):
    out = C.reconcile(star.order_trips(spark, root), star.raw_stop_visits(spark, root), "trip_id", "occupancy_after", "occupancy_avg_pct", "occupancy_max_pct")
    return out.select("trip_id", "occupancy_avg_pct", "occupancy_max_pct")


@query("C22_on_time_flag", "SELECT trip_id, departure_delay_min <= 5 AS on_time FROM trips_core")
def _(spark, root):
    return star.trips_core(spark, root).select("trip_id", C.on_time("departure_delay_min").alias("on_time"))


@query(
    "C23_schedules_view",
    "SELECT trip_id, route_id, direction, CAST(date AS VARCHAR) AS date, us, departure_delay_min, scheduled_headway_min, actual_headway_min FROM trips",
)
def _(spark, root):
    t = star.trips(spark, root)
    return C.schedules(t).drop("scheduled_departure").join(t.select("trip_id", "us"), "trip_id")


@query(
    "C24_cleaning_log",
    """SELECT 'stop_trips' AS dataset, 'dedupe' AS step, 'drop duplicate (trip_id, seq)' AS operation, (SELECT count(*) FROM raw_visits) - (SELECT count(*) FROM visits_first) AS rows_affected
    UNION ALL SELECT 'stop_trips', 'drop', 'drop rows with unknown stop_id', (SELECT count(*) FROM visits_first WHERE stop_id = '?')
    UNION ALL SELECT 'stop_trips', 'drop', 'drop rows on unknown trip', (SELECT count(*) FROM visits_first WHERE stop_id <> '?' AND trip_id NOT IN (SELECT trip_id FROM valid_trips))
    UNION ALL SELECT 'stop_trips', 'drop/impute', 'terminal arrival times repaired', (SELECT count(*) FROM visits_first WHERE stop_id <> '?' AND trip_id IN (SELECT trip_id FROM valid_trips)) - (SELECT count(*) FROM visits_kept)
    UNION ALL SELECT 'stop_trips', 'impute', 'arrival delay from trip median', (SELECT count(*) FROM visits_kept WHERE arr_delay_min IS NULL)""",
)
def _(spark, root):
    log = C.CleaningLog(spark)
    out = C.clean_stop_visits(star.raw_visits(spark, root), star.stop_names(spark, root), star.valid_trips(spark, root), star.VISIT_ORDER, log)
    materialise(out, "stop_trips")
    return log.frame()


@query(
    "C25_rows_before_after",
    """SELECT 'stop_trips' AS dataset, (SELECT count(*) FROM raw_visits) AS rows_before, (SELECT count(*) FROM clean_visits) AS rows_after
    UNION ALL SELECT 'vehicles', (SELECT count(*) FROM raw_vehicles), (SELECT count(*) FROM raw_vehicles)""",
)
def _(spark, root):
    visits, vehicles = star.raw_visits(spark, root), star.raw_vehicles(spark, root)
    cleaned = C.clean_stop_visits(visits, star.stop_names(spark, root), star.valid_trips(spark, root), star.VISIT_ORDER)
    return C.layer_summary({"stop_trips": visits, "vehicles": vehicles}, {"stop_trips": cleaned, "vehicles": C.clean_vehicles(vehicles)})


@query("C26_clean_trips", "SELECT * FROM clean_trips")
def _(spark, root):
    out = C.clean_trips(
        star.raw_trips(spark, root), star.route_names(spark, root), star.vehicles(spark, root), star.vehicle_pools(spark, root),
        star.TRIP_ORDER, digits=None, stage=materialise,
    )
    return out.select(
        "trip_id", "route_id", "vehicle_id", "capacity", "date", "departure_delay_min", "occupancy_max_pct", "occupancy_avg_pct",
        "boardings", "alightings", "day_type", "weather", "on_time",
    )


@query("C26_clean_stop_visits", "SELECT * FROM clean_visits")
def _(spark, root):
    out = C.clean_stop_visits(star.raw_visits(spark, root), star.stop_names(spark, root), star.valid_trips(spark, root), star.VISIT_ORDER, digits=None)
    return out.select("trip_id", "seq", "stop_id", "arr_delay_min", "boarded", "alighted", "onboard_after", "occupancy_after")


@query("C26_clean_tickets", "SELECT * FROM clean_tickets")
def _(spark, root):
    out = C.clean_tickets(star.raw_tickets(spark, root), star.valid_trips(spark, root), star.TICKET_ORDER, stage=materialise)
    return out.select("ticket_id", "trip_id", "route_id", "passenger_id", "distance_km", "fare", "travel_min", "pass_type")


# A contract of the orders table that its data break in each way: a missing and an extra column, a wrong type, a value
# outside its list, and values outside their bounds.
ORDERS = contracts.TableContract(
    "orders",
    {
        "o_orderkey": "integer", "o_custkey": "string", "o_orderstatus": "category", "o_totalprice": "numeric",
        "o_orderdate": "datetime", "o_note": "string",
    },
    ("o_custkey",),
    {"o_orderstatus": ("F", "O")},
    {"o_totalprice": (5000, 400000)},
)
_HELD = "(SELECT column_name FROM information_schema.columns WHERE table_name = 'orders')"
_WANTED = "(VALUES " + ", ".join(f"('{c}')" for c in ORDERS.columns) + ") w(c)"
_MISSING = f"SELECT 'error' AS level, 'Missing required column: ' || c AS message FROM {_WANTED} WHERE c NOT IN {_HELD}"
_EXTRA = f"SELECT '{{level}}' AS level, 'Unexpected column: ' || column_name AS message FROM {_HELD} WHERE column_name NOT IN (SELECT c FROM {_WANTED})"
_TYPES = "SELECT '{level}' AS level, 'Type mismatch in o_custkey: expected string, found ' || lower(typeof(o_custkey)) AS message FROM (SELECT o_custkey FROM orders LIMIT 1)"
_KEY = "SELECT 'error' AS level, 'Primary key o_custkey is not unique: ' || sum(n) || ' rows share a key' AS message FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)"
_VALUES = "SELECT 'error' AS level, 'Invalid category values in o_orderstatus: ' || string_agg(v, ', ' ORDER BY v) AS message FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))"
_BOUNDS = "SELECT 'error' AS level, 'o_totalprice: ' || count(*) || ' values below 5000' AS message FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT 'error' AS level, 'o_totalprice: ' || count(*) || ' values above 400000' AS message FROM orders WHERE o_totalprice > 400000"


def _contract_sql(level: str) -> str:
    return " UNION ALL ".join((_MISSING, _EXTRA.format(level=level), _TYPES.format(level=level), _KEY, _VALUES, _BOUNDS))


@query("V13_missing_and_extra_columns", f"SELECT * FROM ({_contract_sql('warning')}) WHERE message LIKE '%column: %'")
def _(spark, root):
    found = contracts.validate_dataset(star.table(spark, root, "orders"), "orders", contract=ORDERS)
    return contracts.issue_rows(spark, found).where("message LIKE '%column: %'")


@query("V15_type_conformance", f"SELECT * FROM ({_contract_sql('warning')}) WHERE message LIKE 'Type%'")
def _(spark, root):
    found = contracts.validate_dataset(star.table(spark, root, "orders"), "orders", contract=ORDERS)
    return contracts.issue_rows(spark, found).where("message LIKE 'Type%'")


@query("V18_strict_result", _contract_sql("error"))
def _(spark, root):
    found = contracts.validate_dataset(star.table(spark, root, "orders"), "orders", strict=True, contract=ORDERS)
    return contracts.issue_rows(spark, found)


@query("V19_validate_file", _contract_sql("warning"))
def _(spark, root):
    return contracts.issue_rows(spark, contracts.validate_file(spark, f"{root}/orders.parquet", contract=ORDERS))
