"""Table contracts: required columns, logical types, categories, bounds and keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: dict[str, str]
    key: tuple[str, ...] = ()
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)


@dataclass
class ContractResult:
    valid: bool
    errors: list[str]
    warnings: list[str]
    schema_info: dict


# The ten table contracts.
_S, _N, _I, _D, _B, _C = "string", "numeric", "integer", "datetime", "boolean", "category"
CONTRACTS = {
    c.name: c
    for c in (
        TableContract(
            "routes",
            {"route_id": _S, "route_name": _S, "category": _C, "length_km": _N},
            ("route_id",),
            {"category": ("core", "feeder", "express")},
            {"length_km": (0.5, 80)},
        ),
        TableContract(
            "stops",
            {"stop_id": _S, "stop_name": _S, "zone": _S, "lat": _N, "lon": _N},
            ("stop_id",),
            {},
            {"lat": (-90, 90), "lon": (-180, 180)},
        ),
        TableContract(
            "route_stops",
            {"route_id": _S, "stop_id": _S, "seq": _I, "segment_km": _N},
            ("route_id", "seq"),
            {},
            {"seq": (1, 60), "segment_km": (0, 20)},
        ),
        TableContract(
            "vehicles",
            {"vehicle_id": _S, "vehicle_type": _C, "capacity": _I},
            ("vehicle_id",),
            {"vehicle_type": ("standard", "articulated", "mini")},
            {"capacity": (1, 400)},
        ),
        TableContract(
            "calendar",
            {"date": _D, "day_type": _C, "weather": _C, "season": _C},
            ("date",),
            {
                "day_type": ("weekday", "weekend", "holiday"),
                "weather": ("clear", "rain", "snow", "storm"),
                "season": ("winter", "spring", "summer", "autumn"),
            },
        ),
        TableContract(
            "events",
            {"event_id": _S, "date": _D, "kind": _C, "demand_multiplier": _N},
            ("event_id",),
            {"kind": ("sports", "concert", "festival", "accident", "construction")},
            {"demand_multiplier": (0.5, 3.0)},
        ),
        TableContract(
            "trips",
            {
                "trip_id": _S, "route_id": _S, "vehicle_id": _S, "date": _D, "scheduled_departure": _D,
                "actual_departure": _D, "day_type": _C, "weather": _C, "direction": _I, "hour": _I, "boardings": _I,
                "alightings": _I, "capacity": _I, "is_peak": _B, "on_time": _B, "departure_delay_min": _N,
                "distance_km": _N, "scheduled_travel_min": _N, "actual_travel_min": _N, "occupancy_avg_pct": _N,
                "occupancy_max_pct": _N, "scheduled_headway_min": _N, "actual_headway_min": _N,
            },
            ("trip_id",),
            {"day_type": ("weekday", "weekend", "holiday"), "weather": ("clear", "rain", "snow", "storm")},
            {
                "hour": (0, 23), "direction": (0, 1), "departure_delay_min": (-15, 120), "occupancy_avg_pct": (0, 200),
                "occupancy_max_pct": (0, 200), "boardings": (0, 400), "alightings": (0, 400), "capacity": (1, 400),
                "distance_km": (0.1, 100), "scheduled_travel_min": (1, 300), "actual_travel_min": (1, 300),
            },
        ),
        TableContract(
            "stop_trips",
            {
                "trip_id": _S, "stop_id": _S, "seq": _I, "boarded": _I, "alighted": _I, "onboard_after": _I,
                "scheduled_arrival": _D, "actual_arrival": _D, "arr_delay_min": _N,
            },
            ("trip_id", "seq"),
            {},
            {
                "seq": (1, 60), "arr_delay_min": (-10, 160), "boarded": (0, 300), "alighted": (0, 300),
                "onboard_after": (0, 500),
            },
        ),
        TableContract(
            "tickets",
            {
                "ticket_id": _S, "passenger_id": _S, "route_id": _S, "boarding_stop_id": _S, "alighting_stop_id": _S,
                "boarding_datetime": _D, "alighting_datetime": _D, "distance_km": _N, "travel_min": _N, "fare": _N,
                "pass_type": _C,
            },
            (),
            {"pass_type": ("single", "day", "weekly", "monthly")},
            {"distance_km": (0.1, 100), "travel_min": (0.1, 300), "fare": (0.1, 1000)},
        ),
        TableContract(
            "passengers",
            {"passenger_id": _S, "home_zone": _C, "pass_type": _C, "birth_year": _I, "annual_trips": _I},
            ("passenger_id",),
            {
                "pass_type": ("single", "day", "weekly", "monthly"),
                "home_zone": ("residential", "mixed", "commercial", "university", "industrial"),
            },
            {"birth_year": (1940, 2012), "annual_trips": (1, 400)},
        ),
    )
}

_CONFORMS = {
    "string": (T.StringType,),
    "category": (T.StringType, T.BooleanType, T.IntegralType),
    "integer": (T.IntegralType,),
    "numeric": (T.NumericType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "boolean": (T.BooleanType,),
}


def schema_issues(df: DataFrame, contract: TableContract) -> tuple[list[str], list[str], list[str]]:
    """Missing columns, extra columns and type mismatches, from the schema alone (no job runs)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in contract.columns if c not in have]
    extra = [c for c in have if c not in contract.columns]
    wrong = [
        f"{c}: expected {kind}, found {have[c].simpleString()}"
        for c, kind in contract.columns.items()
        if c in have and not isinstance(have[c], _CONFORMS[kind])
    ]
    return missing, extra, wrong


def category_rule(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).cast("string").isin(*allowed)


def bound_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows below and above each column's bounds, one result row per column, in one pass."""
    aggs = []
    for c, (lo, hi) in bounds.items():
        v = F.col(c).try_cast("double")
        aggs += [F.count_if(v < lo).alias(f"{c}__lo"), F.count_if(v > hi).alias(f"{c}__hi")]
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__lo").alias("below"), F.col(f"{c}__hi").alias("above"))
        for c in bounds
    ]
    return wide.select(F.inline(F.array(*rows)))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).count().where(F.col("count") > 1)


def invalid_values(df: DataFrame, column: str, allowed: Sequence[str], limit: int = 5) -> DataFrame:
    """The first values (in order) outside the allowed set, with their counts."""
    bad = df.where(category_rule(column, allowed)).groupBy(F.col(column).cast("string").alias("value")).count()
    return bad.orderBy("value").limit(limit)


def validate_dataset(df: DataFrame, name: str, strict: bool = False, contract: TableContract | None = None) -> ContractResult:
    """Check one dataset against its contract, by name or given; strict mode turns warnings into errors."""
    contract = contract or CONTRACTS.get(name)
    if contract is None:
        return ContractResult(False, [f"Unknown dataset: {name}"], [], {})
    errors, warnings = [], []
    missing, extra, wrong = schema_issues(df, contract)
    errors += [f"Missing required column: {c}" for c in missing]
    warnings += [f"Unexpected column: {c}" for c in extra]
    warnings += [f"Type mismatch in {w}" for w in wrong]
    have = set(df.columns)
    if contract.key and set(contract.key) <= have:
        n = duplicate_keys(df, contract.key).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        if n:
            errors.append(f"Primary key {'+'.join(contract.key)} is not unique: {n} rows share a key")
    for c, allowed in contract.categories.items():
        if c in have:
            bad = [r["value"] for r in invalid_values(df, c, allowed).collect()]
            if bad:
                errors.append(f"Invalid category values in {c}: {', '.join(bad)}")
    bounds = {c: b for c, b in contract.bounds.items() if c in have}
    if bounds:
        for r in bound_counts(df, bounds).collect():
            lo, hi = bounds[r["column"]]
            if r["below"]:
                errors.append(f"{r['column']}: {r['below']} values below {lo}")
            if r["above"]:
                errors.append(f"{r['column']}: {r['above']} values above {hi}")
    if strict:
        errors, warnings = errors + warnings, []
    info = {"columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}}
    return ContractResult(not errors, errors, warnings, info)


def issue_rows(spark: SparkSession, result: ContractResult) -> DataFrame:
    """A result as a table of levels and messages; there are at most a few for each column of a contract."""
    rows = [("error", m) for m in result.errors] + [("warning", m) for m in result.warnings]
    return spark.createDataFrame(rows, "level string, message string")


def validate_file(
    spark: SparkSession, path: str, name: str | None = None, strict: bool = False, contract: TableContract | None = None
) -> ContractResult:
    """Validate one file by extension; the dataset name defaults to the file's stem."""
    from headwise.sources import store

    stem, _, ext = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
    if ext not in ("parquet", "csv", "json"):
        return ContractResult(False, [f"Unsupported file format: .{ext}"], [], {})
    try:
        df = store.read_dataset(spark, path)
    except Exception as e:  # the reader's own message goes into the report
        return ContractResult(False, [f"Failed to load {path}: {type(e).__name__}"], [], {})
    return validate_dataset(df, name or stem, strict, contract)


def validate_folder(spark: SparkSession, folder: str, strict: bool = False) -> dict[str, ContractResult]:
    """Validate every contracted dataset of a folder; parquet before csv before json, missing ones reported."""
    from headwise.sources import store

    out = {}
    for name in CONTRACTS:
        paths = [f"{folder}/{name}.{ext}" for ext in ("parquet", "csv", "json")]
        found = next((p for p in paths if store.exists(spark, p)), None)
        if found is None:
            out[name] = ContractResult(False, [f"Missing dataset: {name}"], [], {})
        else:
            out[name] = validate_file(spark, found, name, strict)
    return out


def contract_table(spark: SparkSession) -> DataFrame:
    """The contracts as a table: one row per column."""
    rows = []
    for c in CONTRACTS.values():
        for col, kind in c.columns.items():
            lo, hi = c.bounds.get(col, (None, None))
            rows.append(
                (c.name, col, kind, col in c.key, list(c.categories.get(col, ())) or None,
                 None if lo is None else float(lo), None if hi is None else float(hi))
            )
    schema = "dataset string, column string, type string, in_key boolean, allowed array<string>, lower double, upper double"
    return spark.createDataFrame(rows, schema)
