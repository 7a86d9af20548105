"""Cleaning operators and the whole-table repairs built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions.nullsafe import join_groups
from headwise.functions import scalars as X
from headwise.functions.quantiles import exact_quantile_scalar, exact_quantiles


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order. Spark ranks map-side first, so a heavily copied key stays small."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def id_alias(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.trim(X.col(c).cast("string")), "[- ]", ""))


def canonical_ids(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Messy spellings of an id -> the reference spelling; unknown ids become null."""
    aliases = reference.groupBy(id_alias(ref_column).alias("_alias")).agg(F.min(F.col(ref_column)).alias("_canonical"))
    out = df.withColumn("_alias", id_alias(column)).join(aliases, "_alias", "left")
    return out.withColumn(column, F.col("_canonical")).drop("_alias", "_canonical")


def lenient_times(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in columns if c in df.columns})


def fix_categories(df: DataFrame, columns: Sequence[str], fixes: Mapping[str, str] = S.CATEGORY_FIXES) -> DataFrame:
    have = [c for c in columns if c in df.columns]
    return df.replace(dict(fixes), subset=have) if have else df


def or_default(column: str, allowed: Sequence[str], default: str) -> Column:
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.lit(default))


def known_only(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Rows whose foreign key exists in the reference."""
    return df.join(reference.select(F.col(ref_column).alias(column)).distinct(), column, "left_semi")


def unknown_rows(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    return df.join(reference.select(F.col(ref_column).alias(column)).distinct(), column, "left_anti")


def first_of_pool(pool: DataFrame, column: str, group: str, pool_order: str) -> DataFrame:
    """The first pool member of each group."""
    return pool.groupBy(group).agg(F.min_by(column, pool_order).alias("_pool"))


def repair_from_pool(
    df: DataFrame, column: str, valid: DataFrame, group: str, pool: DataFrame, pool_order: str, keep=None
) -> DataFrame:
    """A key missing from ``valid`` becomes its group's first pool member, else the first valid key overall.

    Rows without a key match nothing, so the join deals them into pieces. ``keep(df, name)`` may persist the row for each
    group, whose size Spark then knows before it plans the join.
    """
    known = valid.select(F.col(column), F.lit(0).alias("_piece")).distinct().withColumn("_known", F.lit(True))
    first = first_of_pool(pool, column, group, pool_order)
    first = keep(first, "pool_first") if keep is not None else first
    overall = valid.agg(F.min(column)).scalar()
    dealt = df.withColumn("_piece", F.when(F.col(column).isNull(), _piece(df)).otherwise(0))
    out = dealt.join(known, [column, "_piece"], "left").join(first, group, "left")
    repaired = F.coalesce(F.col("_pool"), overall)
    fixed = F.when(F.col(column).isNull(), overall).when(F.col("_known").isNull(), repaired).otherwise(F.col(column))
    return out.withColumn(column, fixed).drop("_known", "_pool", "_piece")


PIECES = 64


def _piece(df: DataFrame) -> Column:
    """Number of the piece that a row of a frequent key falls into, by all its columns."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(PIECES)).cast("int")


def lookup_chain(df: DataFrame, key: str, reference: DataFrame, value: str, default, frequent: DataFrame | None = None) -> DataFrame:
    """Reference value, else the row's own, else a constant.

    ``frequent`` lists keys that a large share of the rows may hold: their rows are dealt into pieces for the join.
    """
    ref = reference.select(key, F.col(value).alias("_ref"))
    on = [key]
    if frequent is not None:
        often = frequent.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_often", F.lit(True))
        copies = F.sequence(F.lit(0), F.when(F.col("_often"), PIECES - 1).otherwise(0))
        ref = ref.join(often, key, "left").select(key, "_ref", F.explode(copies).alias("_piece"))
        df = df.join(often, key, "left").withColumn("_piece", F.when(F.col("_often"), _piece(df)).otherwise(0)).drop("_often")
        on.append("_piece")
    out = df.join(ref, on, "left").drop("_piece")
    own = F.col(value) if value in df.columns else F.lit(None)
    return out.withColumn(value, F.coalesce("_ref", own, F.lit(default))).drop("_ref")


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Null -> median of the whole column (a scalar subquery)."""
    return df.withColumn(column, F.coalesce(F.col(column), exact_quantile_scalar(df, column, 0.5)))


def impute_group_median(df: DataFrame, keys: Sequence[str], column: str, default: float | None = None) -> DataFrame:
    """Null -> median of its group -> constant."""
    med = exact_quantiles(df, keys, column, {"_med": 0.5})
    parts = [F.col(column), F.col("_med")] + ([X.dbl(default)] if default is not None else [])
    return join_groups(df, med, list(keys), "left").withColumn(column, F.coalesce(*parts)).drop("_med")


def clip_round(column: str, lo: float, hi: float, digits: int | None = None) -> Column:
    return X.rounded(X.clip(column, lo, hi), digits)


def default_by_type(column: str, kind: str, defaults: Mapping[str, int], fallback: int) -> Column:
    """Missing or non-positive value -> the default of its type."""
    good = F.col(column) > 0
    return F.when(good, F.col(column)).otherwise(X.code_of(kind, defaults, fallback))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_time(df: DataFrame, column: str, other: str) -> DataFrame:
    """One timestamp from another; rows with neither are dropped."""
    return df.withColumn(column, F.coalesce(column, other)).where(F.col(column).isNotNull())


def positive_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col(end) > F.col(start))


def from_parent(df: DataFrame, key: str, parent: DataFrame, column: str) -> DataFrame:
    """Attribute overwritten by the parent's; ``_changed`` tells where it differed."""
    p = parent.select(key, F.col(column).alias("_parent"))
    out = df.join(p, key, "left")
    value = F.coalesce("_parent", F.col(column))
    return out.withColumn("_changed", F.coalesce(value != F.col(column), F.lit(False))).withColumn(column, value).drop("_parent")


def recomputed_fare(fare: str, distance: str, pass_type: str, t: S.Thresholds = S.DEFAULTS) -> Column:
    """Missing fare -> (base + rate x km) x discount of the pass."""
    discount = X.code_of(pass_type, S.FARE_DISCOUNT, 1.0)
    return F.coalesce(F.col(fare), (X.dbl(t.fare_base) + X.dbl(t.fare_per_km) * F.col(distance)) * discount)


def running_balance(df: DataFrame, key: str, seq: str, into: str, out: str, lo: float, hi: float, name: str) -> DataFrame:
    """Running in-minus-out along a sequence, clipped. The sequence has one row per position."""
    w = W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, X.clip(F.sum(F.col(into) - F.col(out)).over(w), lo, hi))


def reconcile(parent: DataFrame, child: DataFrame, key: str, value: str, mean: str, top: str) -> DataFrame:
    """Parent columns replaced by the mean and maximum (in percent) of its children, none = 0."""
    agg = child.groupBy(key).agg((F.avg(value) * 100).alias("_mean"), (F.max(value) * 100).alias("_max"))
    zero = X.dbl(0.0)
    out = parent.join(agg, key, "left")
    return out.withColumns({mean: F.coalesce("_mean", zero), top: F.coalesce("_max", zero)}).drop("_mean", "_max")


def on_time(delay: str, t: S.Thresholds = S.DEFAULTS) -> Column:
    return F.col(delay) <= t.on_time_max


SCHEDULE_COLUMNS = (
    "trip_id", "route_id", "direction", "date", "scheduled_departure", "actual_departure", "departure_delay_min",
    "scheduled_headway_min", "actual_headway_min",
)


def schedules(trips: DataFrame) -> DataFrame:
    return trips.select(*[c for c in SCHEDULE_COLUMNS if c in trips.columns])


LOG_SCHEMA = "dataset string, step string, operation string, rows_affected long"


class CleaningLog:
    """Counts gathered while the cleaned tables are written, without extra passes over the data."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._entries: list[tuple[str, str, str, Observation, Observation | None]] = []

    def flagged(self, df: DataFrame, dataset: str, step: str, operation: str, cond: Column) -> DataFrame:
        """Count the rows of ``df`` for which the condition holds."""
        seen = Observation()
        self._entries.append((dataset, step, operation, seen, None))
        return df.observe(seen, F.coalesce(X.count_if(cond), F.lit(0)).alias("n"))

    def counted(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("n")), seen

    def dropped(self, dataset: str, step: str, operation: str, before: Observation, after: Observation) -> None:
        self._entries.append((dataset, step, operation, before, after))

    def rows(self) -> list[tuple[str, str, str, int]]:
        out = []
        for dataset, step, operation, seen, after in self._entries:
            n = seen.get["n"] - (after.get["n"] if after is not None else 0)
            out.append((dataset, step, operation, int(n)))
        return out

    def frame(self) -> DataFrame:
        """The log as a table; call after the cleaned tables have been written."""
        return self.spark.createDataFrame(self.rows(), LOG_SCHEMA)


def layer_summary(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """Rows before and after cleaning per dataset."""
    out = None
    for name, raw in before.items():
        if name not in after:
            continue
        b = raw.agg(F.count(F.lit(1)).alias("rows_before"))
        a = after[name].agg(F.count(F.lit(1))).scalar()
        one = b.select(F.lit(name).alias("dataset"), "rows_before", a.alias("rows_after"))
        out = one if out is None else out.unionByName(one)
    return out


def clean_vehicles(raw: DataFrame, order: Sequence[str] = ("vehicle_type", "capacity")) -> DataFrame:
    first = keep_first(raw, ["vehicle_id"], order)
    cap = default_by_type("capacity", "vehicle_type", S.VEHICLE_CAPACITY, S.DEFAULTS.default_capacity)
    return first.withColumn("capacity", cap.cast("int"))


def clean_passengers(raw: DataFrame, order: Sequence[str] = ("age_group", "birth_year")) -> DataFrame:
    first = impute_group_median(keep_first(raw, ["passenger_id"], order), ["age_group"], "birth_year")
    trips = X.clip(F.coalesce(F.col("annual_trips").try_cast("double"), X.dbl(1.0)), 1.0, 400.0)
    return first.withColumns({"birth_year": F.col("birth_year").cast("int"), "annual_trips": trips.cast("int")})


def clean_reference_tables(
    raw: Mapping[str, DataFrame], log: CleaningLog, order: Mapping[str, Sequence[str]]
) -> dict[str, DataFrame]:
    """Dedupe and normalise the dimension tables. ``order`` decides which copy of a key is kept, per table."""
    out = dict(raw)

    def dedupe(name: str, keys: list[str]) -> DataFrame:
        before, seen = log.counted(raw[name])
        first, left = log.counted(keep_first(before, keys, order.get(name, keys)))
        log.dropped(name, "dedupe", f"drop duplicate {'+'.join(keys)}", seen, left)
        return first

    if "routes" in raw:
        out["routes"] = fix_categories(dedupe("routes", ["route_id"]), ["category"])
    if "stops" in raw:
        out["stops"] = dedupe("stops", ["stop_id"])
    if "route_stops" in raw:
        out["route_stops"] = dedupe("route_stops", ["route_id", "seq"])
        if "routes" in out:
            out["route_stops"] = known_only(out["route_stops"], "route_id", raw["routes"], "route_id")
    if "vehicles" in raw:
        seen = log.flagged(
            raw["vehicles"], "vehicles", "repair", "fix impossible/missing capacity",
            F.col("capacity").isNull() | (F.col("capacity") <= 0),
        )
        out["vehicles"] = clean_vehicles(seen, order.get("vehicles", ("vehicle_type", "capacity")))
    if "passengers" in raw:
        out["passengers"] = clean_passengers(raw["passengers"], order.get("passengers", ("age_group", "birth_year")))
    if "calendar" in raw:
        out["calendar"] = fix_categories(dedupe("calendar", ["date"]), ["weather"])
    return out


def clean_trips(
    raw: DataFrame, routes: DataFrame, vehicles: DataFrame, pool: DataFrame, order: Sequence[str],
    log: CleaningLog | None = None, digits: int | None = 1, t: S.Thresholds = S.DEFAULTS, stage=None,
) -> DataFrame:
    """Repair one raw trip table: ids, duplicates, times, vehicles, measures, categories.

    ``stage(df, name)`` persists the rows before imputation, so that the medians and the repair read them back
    instead of repeating the joins above. It also persists the route ids and the vehicles that a repair gives to many rows, so
    that Spark knows how few they are.
    """
    log = log or CleaningLog(raw.sparkSession)
    frequent = None
    if stage is not None:
        routes = stage(routes.select("route_id").distinct(), "trip_routes")
        heads = first_of_pool(pool, "vehicle_id", "route_id", "pool_order").select(F.col("_pool").alias("vehicle_id"))
        frequent = stage(heads.unionByName(vehicles.agg(F.min("vehicle_id").alias("vehicle_id"))), "trip_repairs")
    df = canonical_ids(raw, "route_id", routes, "route_id")
    df, all_rows = log.counted(df)
    df, kept = log.counted(keep_first(df, ["trip_id"], order))
    log.dropped("trips", "dedupe", "drop duplicate trip_id", all_rows, kept)
    df = lenient_times(df, ["scheduled_departure", "actual_departure"])
    df, timed = log.counted(drop_missing(df, ["scheduled_departure"]))
    log.dropped("trips", "drop", "drop trips without a scheduled departure", kept, timed)
    df = df.withColumns(
        {
            "actual_departure": F.coalesce("actual_departure", "scheduled_departure"),
            "date": F.to_date("scheduled_departure"),
        }
    )
    df, routed = log.counted(known_only(df, "route_id", routes, "route_id"))
    log.dropped("trips", "drop", "drop trips on unknown route", timed, routed)
    df = repair_from_pool(df, "vehicle_id", vehicles, "route_id", pool, "pool_order", keep=stage)
    df = lookup_chain(df, "vehicle_id", vehicles, "capacity", t.default_capacity, frequent)
    measures = [
        "departure_delay_min", "occupancy_avg_pct", "occupancy_max_pct", "boardings", "alightings", "distance_km",
        "scheduled_travel_min", "actual_travel_min",
    ]
    df = to_numbers(df, measures)
    df = log.flagged(df, "trips", "impute", "departure delay from column median", F.col("departure_delay_min").isNull())
    if stage is not None:
        df = stage(df, "trips_staged")
    medians = df.select("route_id", "departure_delay_min", "occupancy_max_pct", "occupancy_avg_pct")
    delay_median = exact_quantile_scalar(medians, "departure_delay_min", 0.5)
    avg_median = exact_quantile_scalar(medians, "occupancy_avg_pct", 0.5)
    by_route = exact_quantiles(medians, ["route_id"], "occupancy_max_pct", {"_occ": 0.5})
    df = join_groups(df, by_route, ["route_id"], "left")
    filled = {
        "departure_delay_min": X.clip(F.coalesce("departure_delay_min", delay_median), -5.0, 120.0),
        "occupancy_max_pct": X.clip(F.coalesce("occupancy_max_pct", "_occ", X.dbl(0.0)), 0.0, 200.0),
        "occupancy_avg_pct": X.clip(F.coalesce("occupancy_avg_pct", avg_median, X.dbl(0.0)), 0.0, 200.0),
        "boardings": X.clip(F.coalesce("boardings", X.dbl(0.0)), 0.0, 400.0),
        "alightings": X.clip(F.coalesce("alightings", X.dbl(0.0)), 0.0, 400.0),
    }
    df = df.withColumns(filled).drop("_occ")
    df = df.withColumn("departure_delay_min", X.rounded(F.col("departure_delay_min"), digits))
    df = fix_categories(df, ["day_type", "weather"])
    return df.withColumns(
        {
            "day_type": or_default("day_type", tuple(S.DAY_TYPE_CODES), "weekday"),
            "weather": or_default("weather", tuple(S.WEATHER_CODES), "clear"),
            "on_time": on_time("departure_delay_min", t),
        }
    )


def clean_stop_visits(
    raw: DataFrame, stops: DataFrame, trips: DataFrame, order: Sequence[str], log: CleaningLog | None = None,
    digits: int | None = 1, t: S.Thresholds = S.DEFAULTS,
) -> DataFrame:
    """Repair raw stop visits and rebuild the onboard trajectory from boardings and alightings."""
    log = log or CleaningLog(raw.sparkSession)
    df, all_rows = log.counted(raw)
    df, kept = log.counted(keep_first(df, ["trip_id", "seq"], order))
    log.dropped("stop_trips", "dedupe", "drop duplicate (trip_id, seq)", all_rows, kept)
    df, stopped = log.counted(canonical_ids(df, "stop_id", stops, "stop_id").where(F.col("stop_id").isNotNull()))
    log.dropped("stop_trips", "drop", "drop rows with unknown stop_id", kept, stopped)
    df, owned = log.counted(known_only(df, "trip_id", trips, "trip_id"))
    log.dropped("stop_trips", "drop", "drop rows on unknown trip", stopped, owned)
    df, timed = log.counted(fill_time(lenient_times(df, ["scheduled_arrival", "actual_arrival"]), "actual_arrival", "scheduled_arrival"))
    log.dropped("stop_trips", "drop/impute", "terminal arrival times repaired", owned, timed)
    df = to_numbers(df, ["arr_delay_min", "boarded", "alighted"])
    df = df.withColumns(
        {
            "arr_delay_min": clip_round("arr_delay_min", -10.0, 160.0, digits),
            "boarded": X.clip(F.coalesce("boarded", X.dbl(0.0)), 0.0, 300.0),
            "alighted": X.clip(F.coalesce("alighted", X.dbl(0.0)), 0.0, 300.0),
        }
    )
    df = log.flagged(df, "stop_trips", "impute", "arrival delay from trip median", F.col("arr_delay_min").isNull())
    # a trip has at most one row per position here, so its median and running balance are small windows
    trip = W.partitionBy("trip_id")
    df = df.withColumn(
        "arr_delay_min", F.coalesce("arr_delay_min", F.percentile("arr_delay_min", 0.5).over(trip), X.dbl(0.0))
    )
    df = running_balance(df, "trip_id", "seq", "boarded", "alighted", 0.0, 500.0, "onboard_after")
    cap = trips.select("trip_id", F.col("capacity").alias("_cap"))
    df = df.join(cap, "trip_id", "left")
    seats = F.greatest(F.coalesce("_cap", F.lit(t.default_capacity)), F.lit(1))
    return df.withColumn("occupancy_after", F.col("onboard_after") / seats).drop("_cap")


def clean_tickets(
    raw: DataFrame, trips: DataFrame, order: Sequence[str], log: CleaningLog | None = None, digits: int | None = None,
    t: S.Thresholds = S.DEFAULTS, stage=None,
) -> DataFrame:
    """Repair raw tickets; the trip is the source of truth for the route."""
    log = log or CleaningLog(raw.sparkSession)
    df, all_rows = log.counted(raw)
    df, kept = log.counted(keep_first(df, ["ticket_id"], order))
    log.dropped("tickets", "dedupe", "drop duplicate ticket_id", all_rows, kept)
    df, owned = log.counted(known_only(df, "trip_id", trips, "trip_id"))
    log.dropped("tickets", "drop", "drop tickets on unknown trip", kept, owned)
    df = from_parent(df, "trip_id", trips, "route_id")
    df = log.flagged(df, "tickets", "repair", "route_id re-aligned to trip", F.col("_changed")).drop("_changed")
    df, timed = log.counted(drop_missing(lenient_times(df, ["boarding_datetime", "alighting_datetime"]), ["boarding_datetime", "alighting_datetime"]))
    log.dropped("tickets", "drop", "drop tickets with invalid datetimes", owned, timed)
    df, ordered = log.counted(positive_intervals(df, "boarding_datetime", "alighting_datetime"))
    log.dropped("tickets", "drop", "drop chronologically impossible tickets", timed, ordered)
    df = to_numbers(df, ["distance_km", "fare", "travel_min"])
    df = log.flagged(df, "tickets", "impute", "distance from route median", F.col("distance_km").isNull())
    if stage is not None:
        df = stage(df, "tickets_staged")
    df = impute_group_median(df, ["route_id"], "distance_km")
    df = df.withColumn("distance_km", clip_round("distance_km", 0.1, 100.0, digits))
    df = log.flagged(df, "tickets", "impute", "fare recomputed from distance", F.col("fare").isNull())
    df = df.withColumn("fare", recomputed_fare("fare", "distance_km", "pass_type", t))
    df = df.withColumns(
        {"fare": clip_round("fare", 0.1, 1000.0, digits), "travel_min": clip_round("travel_min", 0.1, 300.0, digits)}
    )
    df, named = log.counted(drop_missing(df, ["passenger_id"]))
    log.dropped("tickets", "drop", "drop tickets without passenger", ordered, named)
    df = fix_categories(df, ["pass_type"])
    return df.withColumn("pass_type", or_default("pass_type", tuple(S.FARE_DISCOUNT), "single"))


def clean_all(
    raw: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]], keep, log: CleaningLog | None = None
) -> tuple[dict[str, DataFrame], CleaningLog]:
    """The whole layer: dimensions, trips, stop visits, tickets, reconciled occupancy, schedules.

    ``keep(df, name)`` persists a frame and returns the scan of it (see ``session.materialise``); every table is
    written once and read back where a later table refers to it.
    """
    log = log or CleaningLog(next(iter(raw.values())).sparkSession)
    cleaned = {n: keep(d, n) for n, d in clean_reference_tables(raw, log, order).items() if n not in ("trips", "stop_trips", "tickets")}
    trips = keep(
        clean_trips(raw["trips"], cleaned["routes"], cleaned["vehicles"], cleaned["vehicle_pools"], order["trips"], log, stage=keep),
        "trips",
    )
    visits = keep(clean_stop_visits(raw["stop_trips"], cleaned["stops"], trips, order["stop_trips"], log), "stop_trips")
    tickets = keep(clean_tickets(raw["tickets"], trips, order["tickets"], log, stage=keep), "tickets")
    trips = keep(reconcile(trips, visits, "trip_id", "occupancy_after", "occupancy_avg_pct", "occupancy_max_pct"), "trips_reconciled")
    cleaned |= {"trips": trips, "stop_trips": visits, "tickets": tickets, "schedules": schedules(trips)}
    return cleaned, log
