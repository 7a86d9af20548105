"""Business thresholds and fixed vocabularies, passed to the operators as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Every numeric rule an operator applies; override with ``dataclasses.replace``."""

    crowding_high: float = 0.85
    crowding_critical: float = 1.0
    persistent_crowding_min_days: int = 15
    crowded_trip_share: float = 0.2
    critical_trip_share: float = 0.4
    on_time_max: float = 5.0
    moderate_max: float = 9.0
    critical_max: float = 30.0
    reliability_degraded: float = 0.75
    reliability_critical: float = 0.55
    underutilization_max: float = 0.25
    underused_trip_share: float = 0.5
    bunching_ratio: float = 0.5
    gapping_ratio: float = 1.75
    min_valid_headway: float = 2.0
    headway_tolerance: float = 0.2
    adherence_minutes: float = 2.0
    anomaly_zscore: float = 2.5
    bottleneck_percentile: float = 0.6
    terminal_percentile: float = 0.05
    horizon_days: int = 28
    occupancy_target: float = 55.0
    delay_scale: float = 30.0
    default_capacity: int = 80
    fare_base: float = 18.0
    fare_per_km: float = 4.2
    frequent_trips_min: int = 90
    regular_trips_min: int = 20
    occasional_trips_min: int = 4
    peak_share_min: float = 0.7
    compare_cases: int = 100


DEFAULTS = Thresholds()

# Vocabularies, codes, weights and cut points that results depend on.
TIME_BAND_EDGES = (5, 10, 16, 20)
TIME_BAND_LABELS = ("night", "morning peak", "midday", "evening peak", "night")
TIME_BANDS = ("night", "morning peak", "midday", "evening peak")
PEAK_BANDS = ("morning peak", "evening peak")
PEAK_HOURS = (7, 8, 9, 16, 17, 18)
SEVERITY_LABELS = ("on time", "moderate", "severe", "critical")
SEASON_BY_MONTH = {
    12: "winter", 1: "winter", 2: "winter",
    3: "spring", 4: "spring", 5: "spring",
    6: "summer", 7: "summer", 8: "summer",
    9: "autumn", 10: "autumn", 11: "autumn",
}
SEASON_CODES = {"winter": 0, "spring": 1, "summer": 2, "autumn": 3}
WEATHER_CODES = {"clear": 0, "rain": 1, "snow": 2, "storm": 3}
TIME_BAND_CODES = {"night": 0, "morning peak": 1, "midday": 2, "evening peak": 3}
DAY_TYPE_CODES = {"weekday": 0, "weekend": 1, "holiday": 2}
ROUTE_CATEGORY_CODES = {"core": 0, "feeder": 1, "express": 2}
VEHICLE_TYPE_CODES = {"standard": 0, "articulated": 1, "mini": 2}
ZONE_CODES = {"residential": 0, "commercial": 1, "industrial": 2, "mixed": 3, "university": 4}
CODE_MAPS = {
    "season": SEASON_CODES,
    "weather": WEATHER_CODES,
    "time_band": TIME_BAND_CODES,
    "day_type": DAY_TYPE_CODES,
    "route_category": ROUTE_CATEGORY_CODES,
    "vehicle_type": VEHICLE_TYPE_CODES,
    "zone": ZONE_CODES,
}
VEHICLE_CAPACITY = {"standard": 80, "articulated": 130, "mini": 45}
CATEGORY_FIXES = {
    "rainy": "rain", "clearr": "clear", "thunderstorm": "storm",
    "wknd": "weekend", "holliday": "holiday", "snowy": "snow",
}
FARE_DISCOUNT = {"single": 1.0, "day": 0.75, "weekly": 0.50, "monthly": 0.35}
SCORE_WEIGHTS = {
    "demand": 0.20, "reliability": 0.25, "occupancy": 0.15,
    "delay": 0.15, "adherence": 0.10, "bunching": 0.15,
}
CLASS_BANDS = (("Top Performer", 80.0), ("Solid", 65.0), ("Needs Attention", 50.0), ("Action Required", 0.0))
SEGMENT_ORDER = ("commuter", "frequent", "regular", "occasional", "rare")
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
PRIORITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
