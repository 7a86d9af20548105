"""Data-quality checks. All checks of a table share one scan (``validate_tables``), its row checks one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise.functions import scalars as X

ISSUE_SCHEMA = (
    "dataset string, column string, rule string, severity string, bad_rows long, total_rows long, sample string"
)
SAMPLE_ROWS = 3


@dataclass(frozen=True)
class Check:
    """One row-level rule: ``bad`` marks the offending rows, ``shown`` is the value reported for them."""

    column: str
    rule: str
    severity: str
    bad: Column
    shown: Column


def _text(c: Column) -> Column:
    return c.cast("string")


def not_null(column: str, severity: str = "warning") -> Check:
    return Check(column, "missing values", severity, F.col(column).isNull(), F.lit(None).cast("string"))


def id_format(column: str, pattern: str, severity: str = "error") -> Check:
    """Non-null ids must match the pattern from their first character on."""
    c = _text(F.col(column))
    return Check(column, "malformed id", severity, c.isNotNull() & ~c.rlike(f"^(?:{pattern})"), c)


def in_range(
    column: str, lo: float, hi: float, allow_null: bool = True, label: str = "out of range", severity: str = "error"
) -> Check:
    v = F.col(column).try_cast("double")
    bad = (v < lo) | (v > hi)
    bad = F.coalesce(bad, F.lit(not allow_null))
    return Check(column, label, severity, bad, _text(v))


def in_categories(column: str, allowed: Sequence[str], severity: str = "warning") -> Check:
    c = _text(F.col(column))
    return Check(column, "unknown category value", severity, c.isNotNull() & ~c.isin(*allowed), c)


def _moment(c: Column) -> Column:
    return F.try_to_timestamp(_text(c))


def in_period(column: str, lo: str, hi: str, severity: str = "warning") -> Check:
    """Values must parse as timestamps inside the period; null and unparsable count as bad."""
    ts = _moment(F.col(column))
    good = ts.between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"))
    return Check(column, "invalid/out-of-range timestamp", severity, ~F.coalesce(good, F.lit(False)), _text(F.col(column)))


def in_order(before: str, after: str, severity: str = "error") -> Check:
    b, a = _moment(F.col(before)), _moment(F.col(after))
    return Check(f"{before} > {after}", "chronology violation", severity, F.coalesce(a < b, F.lit(False)), _text(F.col(after)))


def row_issues(df: DataFrame, dataset: str, checks: Sequence[Check], samples: bool = True) -> DataFrame:
    """Issue rows of all row-level checks that fail at least once.

    Counts come from one aggregation. Samples are the smallest distinct bad values; the ranking keeps three rows per
    check in every map task, so a check that fails everywhere ships no more than one that fails rarely.
    """
    ident = [(F.lit(dataset).alias("dataset"), F.lit(c.column).alias("column"), F.lit(c.rule).alias("rule"), F.lit(c.severity).alias("severity")) for c in checks]
    counted = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.coalesce(X.count_if(c.bad), F.lit(0)).alias(f"_{i}") for i, c in enumerate(checks)]
    )
    rows = [
        F.struct(F.lit(i).alias("_i"), *ident[i], F.col(f"_{i}").alias("bad_rows"), F.col("_total").alias("total_rows"))
        for i in range(len(checks))
    ]
    issues = counted.select(F.inline(F.array(*rows))).where(F.col("bad_rows") > 0)
    if not samples:
        return issues.drop("_i").withColumn("sample", F.lit(None).cast("string"))
    failing = F.array(*[F.when(c.bad, F.struct(F.lit(i).alias("i"), c.shown.alias("v"))) for i, c in enumerate(checks)])
    values = df.select(F.explode(F.array_compact(failing)).alias("_f")).select("_f.i", "_f.v").where("v IS NOT NULL").distinct()
    few = values.withColumn("_rn", F.row_number().over(W.partitionBy("i").orderBy("v"))).where(F.col("_rn") <= SAMPLE_ROWS)
    shown = few.groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("sample"))
    return issues.join(shown, F.col("_i") == F.col("i"), "left").drop("_i", "i")


def _issue(counted: DataFrame, dataset: str, column: str, rule: str, severity: str) -> DataFrame:
    return counted.where(F.col("bad_rows") > 0).select(
        F.lit(dataset).alias("dataset"),
        F.lit(column).alias("column"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        "bad_rows",
        "total_rows",
        F.lit(None).cast("string").alias("sample"),
    )


def duplicate_issue(df: DataFrame, dataset: str, keys: Sequence[str], severity: str = "warning") -> DataFrame:
    """Rows beyond the first of each key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = n.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("bad_rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows")
    )
    return _issue(counted, dataset, "+".join(keys), "duplicate records", severity)


def reference_issue(
    df: DataFrame, dataset: str, column: str, reference: DataFrame, ref_column: str, severity: str = "error",
    rule: str = "unknown reference value",
) -> DataFrame:
    """Non-null values without a partner in the reference. Values are counted before the join, so a hot value is one row."""
    values = df.groupBy(_text(F.col(column)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ref = reference.select(_text(F.col(ref_column)).alias("_v")).distinct().withColumn("_known", F.lit(True))
    flagged = values.join(ref, "_v", "left")
    bad = F.col("_v").isNotNull() & F.col("_known").isNull()
    counted = flagged.agg(
        F.coalesce(F.sum(F.when(bad, F.col("_n"))), F.lit(0)).alias("bad_rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
    )
    return _issue(counted, dataset, column, rule, severity)


def backwards_issue(
    df: DataFrame, dataset: str, key: str, seq: str, clock_us: str, tolerance_s: float = 30.0, severity: str = "error",
    column: str = "actual_arrival",
) -> DataFrame:
    """Positions whose clock runs behind the previous position of the sequence by more than the tolerance.

    Copies of a position are first folded to their earliest and latest clock (rows of one position are taken in clock
    order), which leaves at most one row per position for the ordered comparison.
    """
    folded = df.groupBy(key, seq).agg(
        F.min(clock_us).alias("_first"), F.max(clock_us).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    prev = F.lag("_last").over(W.partitionBy(key).orderBy(seq))
    flagged = folded.select("_n", (F.col("_first") < prev - int(tolerance_s * 1_000_000)).alias("_bad"))
    counted = flagged.agg(
        F.coalesce(X.count_if(F.col("_bad")), F.lit(0)).alias("bad_rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows")
    )
    return _issue(counted, dataset, column, "arrival time moves backwards", severity)


def missing_dataset(spark: SparkSession, dataset: str, path: str, reason: str = "missing dataset") -> DataFrame:
    return spark.createDataFrame([(dataset, "-", reason, "error", 1, 0, path)], ISSUE_SCHEMA)


def all_issues(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def severity_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))


# The rule book of the domain tables.
PERIOD = ("2024-01-01", "2025-01-02")
WEATHER = ("clear", "rain", "snow", "storm")
DAY_TYPES = ("weekday", "weekend", "holiday")
PASS_TYPES = ("single", "day", "weekly", "monthly")
ZONES = ("residential", "mixed", "commercial", "university", "industrial")
EVENT_KINDS = ("sports", "concert", "festival", "accident", "construction")


def domain_rules() -> dict[str, list[Check]]:
    """Row rules per dataset (built on call: a Column needs a running session)."""
    return {
        "trips": [
            id_format("trip_id", r"T-\d+"), id_format("route_id", r"R-\d+"),
            in_range("departure_delay_min", -15, 120, label="delay out of bounds"),
            in_range("occupancy_max_pct", 0, 200), in_range("occupancy_avg_pct", 0, 200), in_range("boardings", 0, 400),
            in_range("alightings", 0, 400), in_range("capacity", 1, 400, allow_null=False),
            in_categories("day_type", DAY_TYPES), in_categories("weather", WEATHER),
            in_period("scheduled_departure", *PERIOD), in_period("actual_departure", *PERIOD),
        ],
        "stop_trips": [
            in_range("arr_delay_min", -10, 160), in_range("boarded", 0, 300), in_range("alighted", 0, 300),
            in_range("onboard_after", 0, 500, allow_null=False, label="impossible onboard count"),
            in_range("seq", 1, 60, allow_null=False), in_period("scheduled_arrival", *PERIOD),
        ],
        "tickets": [
            in_range("distance_km", 0.1, 100), in_range("travel_min", 0.1, 300),
            in_range("fare", 0.1, 1000, label="invalid fare"), in_categories("pass_type", PASS_TYPES),
            in_period("boarding_datetime", *PERIOD), in_period("alighting_datetime", *PERIOD),
            in_order("boarding_datetime", "alighting_datetime"),
        ],
        "routes": [not_null("route_id", "error"), not_null("category", "error"), in_range("length_km", 0.5, 80)],
        "stops": [
            not_null("stop_id", "error"), not_null("zone", "error"), in_range("lat", -90, 90, allow_null=False),
            in_range("lon", -180, 180, allow_null=False),
        ],
        "route_stops": [in_range("segment_km", 0.0, 20, allow_null=False)],
        "vehicles": [
            in_range("capacity", 1, 400, allow_null=False, label="impossible capacity"),
            in_categories("vehicle_type", ("standard", "articulated", "mini")),
        ],
        "calendar": [in_categories("weather", WEATHER)],
        "events": [in_categories("kind", EVENT_KINDS), in_range("demand_multiplier", 0.5, 3.0)],
        "passengers": [
            not_null("passenger_id", "error"), not_null("home_zone", "error"), not_null("pass_type", "error"),
            in_range("birth_year", 1940, 2012), in_range("annual_trips", 1, 400),
            in_categories("pass_type", PASS_TYPES), in_categories("home_zone", ZONES),
        ],
    }


# Keys and references per dataset.
KEYS = {
    "trips": (("trip_id",), "error"),
    "stop_trips": (("trip_id", "seq"), "error"),
    "tickets": (("ticket_id",), "error"),
    "routes": (("route_id",), "warning"),
    "stops": (("stop_id",), "warning"),
    "route_stops": (("route_id", "seq"), "warning"),
    "vehicles": (("vehicle_id",), "warning"),
    "calendar": (("date",), "warning"),
    "schedules": (("route_id", "direction", "scheduled_departure"), "warning"),
    "passengers": (("passenger_id",), "warning"),
}
REFERENCES = {
    "trips": (("route_id", "routes", "route_id"), ("vehicle_id", "vehicles", "vehicle_id"), ("date", "calendar", "date")),
    "stop_trips": (("trip_id", "trips", "trip_id"),),
    "tickets": (
        ("passenger_id", "passengers", "passenger_id"), ("trip_id", "trips", "trip_id"), ("route_id", "routes", "route_id"),
        ("boarding_stop_id", "stops", "stop_id"), ("alighting_stop_id", "stops", "stop_id"),
    ),
}


NESTED = ("array", "map", "struct", "variant")


@dataclass(frozen=True)
class _Slot:
    """What a fact stands for: a row of a table, a failed row check, a key, or a value to look up in a reference."""

    kind: str
    table: int
    dataset: str
    column: str = "-"
    rule: str = "-"
    severity: str = "-"


def _key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """One text for a key, different for different keys: each part carries its length, null has none."""
    types = dict(df.dtypes)
    parts = []
    for k in keys:
        c = F.col(k)
        if types[k] in ("float", "double"):
            c = c + F.lit(0.0).cast(types[k])  # the two zeros are one key
        text = F.unix_micros(c).cast("string") if types[k] == "timestamp" else _text(c)
        parts.append(F.when(text.isNotNull(), F.concat(F.length(text), F.lit(":"), text)).otherwise("n"))
    return F.concat(*parts)


def _table_facts(df: DataFrame, first: int, checks: Sequence[Check], key: Sequence[str], refs: Sequence[str]) -> DataFrame:
    """(slot, v) facts of a table in one scan; a row yields one for itself, its failed checks, its key and each reference."""
    values = [(F.lit(True), F.lit(None).cast("string")), *[(c.bad, c.shown) for c in checks]]
    if key:
        values.append((F.lit(True), _key_text(df, key)))
    values += [(F.lit(True), _text(F.col(c))) for c in refs]
    facts = [F.when(when, F.struct(F.lit(first + i).alias("slot"), v.alias("v"))) for i, (when, v) in enumerate(values)]
    return df.select(F.explode(F.array(*facts)).alias("f")).select("f.slot", "f.v").where("slot IS NOT NULL")


def _by_slot(slots: Sequence[_Slot], field: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(s, field)) for s in slots]), F.col("slot") + 1)


def fused_issues(facts: DataFrame, slots: Sequence[_Slot], known: DataFrame | None) -> DataFrame:
    """Issues of any number of tables from their facts: equal facts become counts, and everything else reads the counts.

    Counting is partial before the one shuffle, so a hot value and the rows of a table travel as one row from each map
    task. References are joined on the shuffled key. Conditions of the samples read ``n``, which keeps them above the
    counts; a condition on the slot alone would be pushed into the scans, which would then be read again.
    """
    counts = facts.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n"))
    kind = _by_slot(slots, "kind")
    flagged = counts.withColumn("known", F.lit(None).cast("boolean")) if known is None else counts.join(known, ["slot", "v"], "left")
    bad = (
        F.when(kind == "check", F.col("n"))
        .when(kind == "key", F.col("n") - 1)
        .when((kind == "reference") & F.col("v").isNotNull() & F.col("known").isNull(), F.col("n"))
        .otherwise(0)
    )
    sums = flagged.groupBy("slot").agg(F.sum(bad).alias("bad_rows"), F.sum("n").alias("_rows"))
    whole = F.max(F.when(kind == "rows", F.col("_rows"))).over(W.partitionBy(_by_slot(slots, "table")))
    sums = sums.withColumn("total_rows", whole).where(F.col("bad_rows") > 0)
    shown = counts.where(F.when((F.col("n") > 0) & F.col("v").isNotNull(), kind) == "check")
    few = shown.withColumn("_rn", F.row_number().over(W.partitionBy("slot").orderBy("v"))).where(F.col("_rn") <= SAMPLE_ROWS)
    samples = few.groupBy("slot").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("sample"))
    return sums.join(samples, "slot", "left").select(
        *[_by_slot(slots, f).alias(f) for f in ("dataset", "column", "rule", "severity")], "bad_rows", "total_rows", "sample"
    )


def validate_tables(
    frames: Mapping[str, DataFrame], references: Mapping[str, DataFrame] | None = None,
    rules: Mapping[str, Sequence[Check]] | None = None, keys: Mapping[str, tuple] | None = None,
    refs: Mapping[str, tuple] | None = None, monotone: tuple[str, str, str, str] | None = None,
) -> DataFrame:
    """All applicable checks over all given tables as one issue frame.

    Each table is scanned once for its row checks, samples, key and references, each reference once for all that look
    into it; only ``monotone`` orders its table apart. Rules on columns a table does not have are skipped; referential
    checks run only where a reference is given.
    """
    rules = domain_rules() if rules is None else rules
    keys = KEYS if keys is None else keys
    refs = REFERENCES if refs is None else refs
    facts: list[DataFrame] = []
    apart: list[DataFrame] = []
    slots: list[_Slot] = []
    wanted: dict[tuple[str, str], list[int]] = {}
    for t, (name, df) in enumerate(frames.items()):
        have, types = set(df.columns), dict(df.dtypes)
        checks = [c for c in rules.get(name, ()) if set(c.column.split(" > ")) <= have]
        key, severity = keys[name] if name in keys and set(keys[name][0]) <= have else ((), "")
        if any(types[k].startswith(NESTED) for k in key):
            apart.append(duplicate_issue(df, name, key, severity))
            key = ()
        looked = [r for r in refs.get(name, ()) if references and r[1] in references and r[0] in have]
        if monotone and monotone[0] == name:
            apart.append(backwards_issue(df, name, *monotone[1:]))
        if not (checks or key or looked):
            continue
        facts.append(_table_facts(df, len(slots), checks, key, [r[0] for r in looked]))
        slots.append(_Slot("rows", t, name))
        slots += [_Slot("check", t, name, c.column, c.rule, c.severity) for c in checks]
        if key:
            slots.append(_Slot("key", t, name, "+".join(key), "duplicate records", severity))
        for column, ref, ref_column in looked:
            wanted.setdefault((ref, ref_column), []).append(len(slots))
            slots.append(_Slot("reference", t, name, column, "unknown reference value", "error"))
    known = None
    for (ref, column), numbers in wanted.items():
        values = references[ref].select(_text(F.col(column)).alias("v")).where("v IS NOT NULL").distinct()
        one = values.select(F.explode(F.array(*map(F.lit, numbers))).alias("slot"), "v", F.lit(True).alias("known"))
        known = one if known is None else known.unionByName(one)
    parts = apart
    if facts:
        together = facts[0]
        for f in facts[1:]:
            together = together.unionByName(f)
        parts = [fused_issues(together, slots, known), *apart]
    if not parts:
        raise ValueError("no check applies to the given tables")
    return all_issues(parts)


def validate_layer(
    spark: SparkSession, folder: str, datasets: Sequence[str], reference_folder: str | None = None
) -> DataFrame:
    """Validate the Parquet datasets of a layer; absent and unreadable ones become issue rows."""
    from headwise.sources import store

    frames, problems = {}, []
    for name in datasets:
        path = f"{folder}/{name}.parquet"
        if not store.exists(spark, path):
            problems.append(missing_dataset(spark, name, path))
            continue
        try:
            frames[name] = spark.read.parquet(path)
        except Exception as e:  # the file exists but holds no readable footer
            problems.append(missing_dataset(spark, name, path, f"unreadable dataset ({type(e).__name__})"))
    references = {}
    if reference_folder:
        for name in datasets:
            path = f"{reference_folder}/{name}.parquet"
            if store.exists(spark, path):
                references[name] = spark.read.parquet(path)
    parts = ([validate_tables(frames, references)] if frames else []) + problems
    return all_issues(parts)
