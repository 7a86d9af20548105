"""Domain frames (trips, stop visits, rides, dimensions, events) derived from a TPC-H-like star schema.

Every frame is a projection or join of the given Parquet tables, so all work grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X
from headwise.functions.scans import micros_chunk, previous_values
from headwise.operators import joins as J
from headwise.operators.features import headway


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def clock_us(ts: Column | str) -> Column:
    return F.unix_micros(X.col(ts).cast("timestamp"))


def trip_sources(spark: SparkSession, root: str) -> DataFrame:
    """The stored columns that all columns of a trip follow from."""
    e = table(spark, root, "events")
    weather = F.when(F.col("event_type") == "signup", "rain").when(F.col("event_type") == "purchase", "snow").when(
        F.col("event_type") == "error", "storm"
    ).otherwise("clear")
    return e.select(
        F.col("event_id").alias("trip_id"),
        F.col("user_id").alias("vehicle_id"),
        F.col("ts").alias("scheduled_departure"),
        weather.alias("weather"),
        F.col("value").alias("_value"),
        F.get_json_object("props", "$.k").cast("int").alias("_k"),
    )


def trip_columns(df: DataFrame) -> DataFrame:
    """Adds to stored columns of trips (``trip_sources``) the columns that follow from them."""
    ts, value, k = F.col("scheduled_departure"), F.col("_value"), F.col("_k")
    base = df.select(
        "*",
        (F.col("vehicle_id") % 20).alias("route_id"),
        F.to_date(ts).alias("date"),
        (F.col("trip_id") % 2).alias("direction"),
        (value / 5 - 5).alias("departure_delay_min"),
        k.alias("boardings"),
        k.alias("alightings"),
        (k * X.dbl(1.2)).alias("occupancy_max_pct"),
        (k * X.dbl(0.7)).alias("occupancy_avg_pct"),
        (k / 4 + 20.0).alias("scheduled_travel_min"),
        (k / 4 + 20.0 + value / 5 - 5).alias("actual_travel_min"),
        (k / 10 + 2.0).alias("distance_km"),
        clock_us(ts).alias("us"),
    )
    parts = X.calendar_parts("scheduled_departure")
    base = base.select("*", *[parts[n].alias(n) for n in ("weekday", "month", "is_weekend", "hour")])
    return base.select(
        "*",
        X.season("month").alias("season"),
        X.time_band("hour").alias("time_band"),
        X.delay_severity("departure_delay_min").alias("delay_severity"),
        (F.col("departure_delay_min") <= S.DEFAULTS.on_time_max).alias("on_time"),
        F.when(F.col("is_weekend"), "weekend").otherwise("weekday").alias("day_type"),
        X.time_band("hour").isin(*S.PEAK_BANDS).alias("is_peak"),
    )


TRIP_COLUMNS = (
    "trip_id", "route_id", "vehicle_id", "scheduled_departure", "date", "direction", "departure_delay_min", "weather", "boardings",
    "alightings", "occupancy_max_pct", "occupancy_avg_pct", "scheduled_travel_min", "actual_travel_min", "distance_km", "us", "weekday",
    "month", "is_weekend", "hour", "season", "time_band", "delay_severity", "on_time", "day_type", "is_peak",
)


def trips_core(spark: SparkSession, root: str) -> DataFrame:
    """One row per trip, without the headways (which need the previous departure)."""
    return trip_columns(trip_sources(spark, root)).select(*TRIP_COLUMNS)


def trips(spark: SparkSession, root: str) -> DataFrame:
    """Trips with scheduled and actual headway to the previous departure of the route on that day."""
    core = trips_core(spark, root)
    prev = previous_values(
        core,
        ["route_id", "date"],
        ["us", "trip_id"],
        micros_chunk("us"),
        {"_prev_us": "us", "_prev_delay": "departure_delay_min"},
    )
    sched = headway("us", "_prev_us")
    return prev.select(
        "*",
        sched.alias("scheduled_headway_min"),
        (sched + F.col("departure_delay_min") - F.col("_prev_delay")).alias("actual_headway_min"),
    ).drop("_prev_us", "_prev_delay")


def routes(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier")
    category = F.element_at(F.array(*[F.lit(c) for c in S.ROUTE_CATEGORY_CODES]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(
        F.col("s_suppkey").alias("route_id"),
        F.col("s_name").alias("route_name"),
        category.alias("category"),
        (F.col("s_suppkey") % 20 + 5.5).cast("double").alias("length_km"),
        (F.col("s_suppkey") % 40 + 5).alias("stops_count"),
    )


def vehicles(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer")
    kind = F.element_at(F.array(*[F.lit(v) for v in S.VEHICLE_CAPACITY]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(
        F.col("c_custkey").alias("vehicle_id"),
        kind.alias("vehicle_type"),
        X.code_of(kind, S.VEHICLE_CAPACITY).alias("capacity"),
    )


def raw_vehicles(spark: SparkSession, root: str) -> DataFrame:
    """Vehicles as delivered: missing where the balance is negative, impossible where it is below 100."""
    c = table(spark, root, "customer")
    v = vehicles(spark, root)
    bad = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") < 100, 0).otherwise(F.col("capacity"))
    return v.join(c.select(F.col("c_custkey").alias("vehicle_id"), "c_acctbal"), "vehicle_id").select(
        "vehicle_id", "vehicle_type", bad.alias("capacity")
    )


def zone_by_key(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "region")
    return r.select(F.col("r_regionkey").alias("_zone_key"), F.col("r_name").alias("zone"))


def stops(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").withColumn("_zone_key", (F.col("p_partkey") % 5).cast("int"))
    return p.join(zone_by_key(spark, root), "_zone_key", "left").select(
        F.col("p_partkey").alias("stop_id"),
        F.col("p_name").alias("stop_name"),
        "zone",
        (F.col("p_partkey") % 100 / 100 + 40.0).alias("lat"),
        (F.col("p_partkey") % 77 / 100 + 20.0).alias("lon"),
    )


def order_trips(spark: SparkSession, root: str) -> DataFrame:
    """Parent trips of the stop visits and rides."""
    o = table(spark, root, "orders")
    return o.select(
        F.col("o_orderkey").alias("trip_id"),
        (F.col("o_custkey") % 20).alias("route_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderstatus").alias("trip_status"),
        F.col("o_custkey").alias("vehicle_id"),
    )


def _visit_sources(spark: SparkSession, root: str) -> DataFrame:
    """The stored columns that all columns of a stop visit follow from, those of few values side by side (rows shuffle smaller so)."""
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_partkey").alias("stop_id"),
        F.col("l_suppkey").alias("visit_ref"),
        F.col("l_extendedprice").alias("_price"),
        F.col("l_linenumber").alias("seq"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_quantity").alias("_q"),
        F.col("l_discount").alias("_discount"),
        F.col("l_tax").alias("tax"),
    )


def _visit_columns() -> dict[str, Column]:
    q = F.col("_q")
    return {
        "trip_id": F.col("trip_id"),
        "seq": F.col("seq"),
        "stop_id": F.col("stop_id"),
        "hour": F.col("seq") * 3,
        "boarded": q,
        "alighted": q * (F.lit(1) - F.lit(5) * F.col("_discount")),
        "arr_delay_min": F.col("_price") / 5000 - 5,
        "dwell_sec": F.lit(25.0) + X.dbl(2.5) * q,
        "occupancy_after": q / 45,
        "onboard_after": q,
        "visit_ref": F.col("visit_ref"),
        "tax": F.col("tax"),
        "ship_date": F.col("ship_date"),
    }


def raw_stop_visits(spark: SparkSession, root: str) -> DataFrame:
    """Stop visits as delivered: (trip_id, seq) is not unique."""
    return _visit_sources(spark, root).select(*[c.alias(n) for n, c in _visit_columns().items()])


def stop_facts(spark: SparkSession, root: str, gap_keys: Sequence[str] = ()) -> DataFrame:
    """Stop visits with the context of their trip and stop.

    The joins move the stored columns; what follows from them is computed behind the joins. With ``gap_keys``, only
    these columns of the visits come back, and ``has_gap`` for a null in any column of the row: the joins then move
    one flag in place of the columns.
    """
    context, place = order_trips(spark, root).select("trip_id", "route_id", "date"), stops(spark, root).select("stop_id", "stop_name", "zone")
    if gap_keys:
        visits = J.gap_flag(raw_stop_visits(spark, root).withColumn("time_band", X.time_band("hour")), {*gap_keys, "trip_id", "stop_id"})
        facts = J.add_gaps(visits, J.gap_flag(context, ["trip_id"]), "trip_id")
        return J.add_gaps(facts, J.gap_flag(place, ["stop_id"]), "stop_id").select(*gap_keys, J.GAP)
    sv = _visit_sources(spark, root).join(context, "trip_id", "left").join(place, "stop_id", "left")
    own = _visit_columns()
    order = ["stop_id", "trip_id", *[n for n in own if n not in ("stop_id", "trip_id")]]
    return sv.select(
        *[own[n].alias(n) for n in order], X.time_band(own["hour"]).alias("time_band"), "route_id", "date", "stop_name", "zone"
    )


def raw_rides(spark: SparkSession, root: str) -> DataFrame:
    """Rides before integration: their trip, boarding point (customer) and alighting point (supplier)."""
    li = table(spark, root, "lineitem")
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    pass_type = F.when(F.col("o_orderpriority") == "1-URGENT", "single").when(
        F.col("o_orderpriority") == "2-HIGH", "day"
    ).when(F.col("o_orderpriority") == "3-MEDIUM", "weekly").otherwise("monthly")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("trip_id"),
        (F.col("l_suppkey") % 20).alias("route_id"),
        F.col("o_custkey").alias("passenger_id"),
        F.col("l_suppkey").alias("alighting_ref"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("l_linenumber") * 3).alias("hour"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("fare"),
        F.col("l_quantity").alias("distance_km"),
        (F.col("l_extendedprice") / 1000).alias("travel_min"),
        pass_type.alias("pass_type"),
    ).withColumn("time_band", X.time_band("hour"))


def zoned_nations(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    r = table(spark, root, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("_nation"), F.col("r_name").alias("_zone"))


def rides(spark: SparkSession, root: str) -> DataFrame:
    """Rides with the zones of both ends (the same dimension joined twice under different names)."""
    z = zoned_nations(spark, root)
    board = table(spark, root, "customer").join(z, F.col("c_nationkey") == F.col("_nation")).select(
        F.col("c_custkey").alias("passenger_id"), F.col("_zone").alias("boarding_zone")
    )
    alight = table(spark, root, "supplier").join(z, F.col("s_nationkey") == F.col("_nation")).select(
        F.col("s_suppkey").alias("alighting_ref"), F.col("_zone").alias("alighting_zone")
    )
    return raw_rides(spark, root).join(alight, "alighting_ref", "left").join(board, "passenger_id", "left")


def _event_rows(days: DataFrame, zones: DataFrame, step: Column) -> DataFrame:
    """Two special events on each given day, in neighbouring zones."""
    ordinal = F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")
    ev = days.select("date", step.alias("_step"), ordinal)
    ev = ev.withColumn("_zone_key", ((F.col("_step") + F.col("ordinal")) % 5).cast("int"))
    kinds = F.array(*[F.lit(k) for k in ("sports", "concert", "festival", "accident", "construction")])
    return ev.join(zones, "_zone_key").select(
        F.concat(F.lit("EVT-"), F.date_format("date", "yyyyMMdd"), F.lit("-"), F.col("ordinal").cast("string")).alias("event_id"),
        "date",
        "ordinal",
        "zone",
        F.element_at(kinds, F.col("_zone_key") + 1).alias("kind"),
        (F.col("_zone_key") / 10 + 1.0).alias("demand_multiplier"),
        (F.col("_zone_key") * 2.0 + 1.0).alias("extra_delay_min"),
    )


def ride_events(spark: SparkSession, root: str) -> DataFrame:
    """Special events on the days of the ride calendar whose day of year is a multiple of 30."""
    days = table(spark, root, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    days = days.where(F.dayofyear("date") % 30 == 0)
    return _event_rows(days, zone_by_key(spark, root), F.floor(F.dayofyear("date") / 30).cast("int"))


def trip_events(spark: SparkSession, root: str) -> DataFrame:
    """Special events on every fifth day of the trip calendar."""
    days = table(spark, root, "events").select(F.to_date("ts").alias("date")).distinct()
    days = days.where(F.dayofmonth("date") % 5 == 0)
    return _event_rows(days, zone_by_key(spark, root), F.floor(F.dayofmonth("date") / 5).cast("int"))


def trip_calendar(spark: SparkSession, root: str) -> DataFrame:
    """Calendar of the trip days with weather readings; every tenth day of the month is a holiday."""
    days = table(spark, root, "events").select(F.to_date("ts").alias("date")).distinct()
    dom = F.dayofmonth("date")
    return days.select(
        "date",
        (dom % 10 == 0).alias("is_holiday"),
        (dom % 40 - 5).cast("double").alias("temp_c"),
        (dom % 17).cast("double").alias("precip_mm"),
    )


def route_stops(spark: SparkSession, root: str) -> DataFrame:
    """Stop order of each route: for each (route, seq) the lowest stop id seen there."""
    return (
        raw_stop_visits(spark, root)
        .join(order_trips(spark, root).select("trip_id", "route_id"), "trip_id")
        .groupBy("route_id", "seq")
        .agg(F.min("stop_id").alias("stop_id"))
    )


def passengers(spark: SparkSession, root: str) -> DataFrame:
    """Passengers as delivered: birth year missing where the balance is negative."""
    c = table(spark, root, "customer")
    return c.select(
        F.col("c_custkey").alias("passenger_id"),
        F.col("c_mktsegment").alias("age_group"),
        F.when(F.col("c_acctbal") >= 0, (F.col("c_custkey") % 73 + 1940).cast("double")).alias("birth_year"),
        F.floor(F.col("c_acctbal") / 20).cast("string").alias("annual_trips"),
    )


# Raw tables: the same sources as they might be delivered, with spelling variants, gaps and copies.
TRIP_ORDER = ("seat_ref", "vehicle_id", "departure_delay_min", "boardings", "distance_km")
VISIT_ORDER = ("stop_ref_order", "visit_ref", "arr_delay_min", "boarded")
TICKET_ORDER = ("part_ref", "alighting_ref", "fare_order", "distance_order")


def route_names(spark: SparkSession, root: str) -> DataFrame:
    """The twenty canonical route ids that the raw trips refer to."""
    o = table(spark, root, "orders").select((F.col("o_custkey") % 20).alias("n")).distinct()
    return o.select(F.concat(F.lit("R-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("route_id"))


def _messy(number: Column, spelling: Column, prefix: str, width: int) -> Column:
    """One of four spellings of an id, or an unknown id."""
    digits = F.lpad(number.cast("string"), width, "0")
    return (
        F.when(spelling == 0, F.concat(F.lit(f"{prefix}-"), digits))
        .when(spelling == 1, F.concat(F.lit(prefix.lower()), digits))
        .when(spelling == 2, F.concat(F.lit(f" {prefix} "), digits))
        .when(spelling == 3, F.concat(F.lit(prefix), digits))
        .otherwise(F.lit("?"))
    )


def raw_trips(spark: SparkSession, root: str) -> DataFrame:
    """One row per order line: ids in four spellings or unknown, copies of trip_id, text times and measures."""
    li = table(spark, root, "lineitem")
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    route = _messy(F.col("l_suppkey") % 20, F.when(F.col("l_tax") == 0.08, 9).otherwise(F.col("l_linenumber") % 4), "R", 3)
    weather = F.element_at(
        F.array(*[F.lit(w) for w in ("rainy", "clearr", "snow", "thunderstorm", "fog", "clear", "rain")]), F.col("l_linenumber")
    )
    day_type = F.when(F.col("l_linestatus") == "O", "wknd").when(F.col("l_returnflag") == "R", "holliday").otherwise("weekday")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trip_id"),
        route.alias("route_id"),
        F.when(F.col("l_discount") == 0.03, None).otherwise(F.col("l_partkey")).alias("vehicle_id"),
        F.when(F.col("l_discount") == 0.0, "unknown").otherwise(stamp).alias("scheduled_departure"),
        F.when(F.col("l_tax") != 0.0, stamp).alias("actual_departure"),
        F.when(F.col("l_discount") == 0.1, "n/a").otherwise((price / 1000 - 5).cast("string")).alias("departure_delay_min"),
        F.when(F.col("l_tax") != 0.02, q * 5).alias("occupancy_max_pct"),
        F.when(F.col("l_tax") != 0.05, q * 3).alias("occupancy_avg_pct"),
        (q * 10 - 50).alias("boardings"),
        (q * 9 - 30).alias("alightings"),
        q.alias("distance_km"),
        (q + 20).alias("scheduled_travel_min"),
        (q + 22).alias("actual_travel_min"),
        F.lit(None).cast("int").alias("capacity"),
        day_type.alias("day_type"),
        weather.alias("weather"),
        F.col("l_suppkey").alias("seat_ref"),
    )


def vehicle_pools(spark: SparkSession, root: str) -> DataFrame:
    """Vehicles of each route, in pool order."""
    c = table(spark, root, "customer")
    name = F.concat(F.lit("R-"), F.lpad((F.col("c_custkey") % 20).cast("string"), 3, "0"))
    return c.select(name.alias("route_id"), F.col("c_custkey").alias("vehicle_id"), F.col("c_custkey").alias("pool_order"))


def raw_visits(spark: SparkSession, root: str) -> DataFrame:
    """Stop visits with spelling variants, missing arrivals and text measures."""
    li = table(spark, root, "lineitem")
    q = F.col("l_quantity")
    stop = _messy(F.col("l_partkey"), F.when(F.col("l_tax") == 0.08, 9).otherwise(F.col("l_linenumber") % 4), "S", 7)
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return li.select(
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_linenumber").alias("seq"),
        stop.alias("stop_id"),
        F.when(F.col("l_discount") != 0.04, stamp).alias("scheduled_arrival"),
        F.when(F.col("l_tax") != 0.01, stamp).otherwise(F.lit("lost")).alias("actual_arrival"),
        F.when(F.col("l_discount") == 0.06, "n/a").otherwise((F.col("l_extendedprice") / 500 - 20).cast("string")).alias("arr_delay_min"),
        q.alias("boarded"),
        F.when(F.col("l_discount") == 0.02, None).otherwise(q * (F.lit(1) - F.lit(5) * F.col("l_discount"))).alias("alighted"),
        F.col("l_partkey").alias("stop_ref_order"),
        F.col("l_suppkey").alias("visit_ref"),
    )


def stop_names(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return p.select(F.concat(F.lit("S-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("stop_id"))


def valid_trips(spark: SparkSession, root: str) -> DataFrame:
    """Trips that ran (orders not pending), with route and capacity."""
    return order_trips(spark, root).where(F.col("trip_status") != "P").select(
        "trip_id", "route_id", (F.col("route_id") * 4 + 20).alias("capacity")
    )


def raw_tickets(spark: SparkSession, root: str) -> DataFrame:
    """Tickets with copies, a route of their own, unparsable times, impossible intervals and missing measures."""
    li = table(spark, root, "lineitem")
    o = table(spark, root, "orders")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    minutes = F.floor(F.col("l_extendedprice") / 1000 - 10).cast("long")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("l_linenumber").cast("long") * 10_800_000_000
    pass_type = F.when(F.col("o_orderpriority") == "1-URGENT", "single").when(
        F.col("o_orderpriority") == "2-HIGH", "day"
    ).when(F.col("o_orderpriority") == "3-MEDIUM", "weekly").when(F.col("o_orderpriority") == "5-LOW", "monthly").otherwise("season")

    def stamp(us: Column) -> Column:
        return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")

    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket_id"),
        F.col("l_orderkey").alias("trip_id"),
        (F.col("l_suppkey") % 20).alias("route_id"),
        F.when(F.col("l_tax") == 0.03, None).otherwise(F.col("o_custkey")).alias("passenger_id"),
        F.when(F.col("l_tax") == 0.01, "??").otherwise(stamp(start)).alias("boarding_datetime"),
        stamp(start + minutes * 60_000_000).alias("alighting_datetime"),
        F.when(F.col("l_discount") != 0.05, (F.col("l_quantity") * 3).cast("string")).alias("distance_km"),
        F.when(F.col("l_discount") == 0.07, "free").otherwise((F.col("l_extendedprice") / 50).cast("string")).alias("fare"),
        (F.col("l_extendedprice") / 200).alias("travel_min"),
        pass_type.alias("pass_type"),
        F.col("l_partkey").alias("part_ref"),
        F.col("l_suppkey").alias("alighting_ref"),
        F.col("l_extendedprice").alias("fare_order"),
        F.col("l_quantity").alias("distance_order"),
    )


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """A run log: one entry per event."""
    e = table(spark, root, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("value") > 60, "failed").when(F.col("value") > 50, "warning").when(k == 7, "skipped").otherwise("ok")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("component-"), (F.col("user_id") % 7).cast("string")).alias("component"),
        status.alias("status"),
        F.when(k != 0, F.col("value") * 10).alias("duration_ms"),
    )


def model_versions(spark: SparkSession, root: str) -> DataFrame:
    """Version entries: one per customer, grouped under their market segment."""
    c = table(spark, root, "customer")
    return c.select(
        F.concat(F.lit("v-"), F.col("c_custkey").cast("string")).alias("version_id"),
        F.col("c_mktsegment").alias("model_name"),
        F.when(F.col("c_custkey") % 2 == 0, "tree").otherwise("linear").alias("engine"),
        F.timestamp_seconds(F.col("c_custkey") * 7919 % 100000 + 1704067200).alias("trained_at"),
        F.col("c_acctbal").alias("metric"),
    )
