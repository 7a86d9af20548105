"""Row-level expressions (Column in, Column out)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from headwise import settings as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    return F.lit(float(x))


def label_cuts(c: Column | str, edges: Sequence[float], labels: Sequence[str], closed: str = "right") -> Column:
    """Label of the interval a value falls in; ``closed`` names the side that owns the edge. Null stays null."""
    c = col(c)
    out = None
    for edge, label in zip(edges, labels):
        cond = c <= F.lit(edge) if closed == "right" else c < F.lit(edge)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.when(c.isNotNull(), labels[-1])


def time_band(hour: Column | str) -> Column:
    return label_cuts(hour, S.TIME_BAND_EDGES, S.TIME_BAND_LABELS, closed="left")


def delay_severity(delay: Column | str, t: S.Thresholds = S.DEFAULTS) -> Column:
    return label_cuts(delay, (t.on_time_max, t.moderate_max, t.critical_max), S.SEVERITY_LABELS)


def code_of(c: Column | str, codes: Mapping, default=None) -> Column:
    """Fixed category -> value lookup; unknown categories give ``default``."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    looked = F.try_element_at(F.create_map(*pairs), col(c))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def season(month: Column | str) -> Column:
    return code_of(month, S.SEASON_BY_MONTH)


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """Weekday (Monday = 0), month, weekend flag, hour and minute of day."""
    ts = col(ts)
    return {
        "weekday": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": F.weekday(ts) >= 5,
        "hour": F.hour(ts),
        "minute_of_day": F.hour(ts) * 60 + F.minute(ts),
    }


def cyclical(c: Column | str, period: float, name: str) -> list[Column]:
    theta = col(c).cast("double") * dbl(2.0 * math.pi) / dbl(period)
    return [F.sin(theta).alias(f"{name}_sin"), F.cos(theta).alias(f"{name}_cos")]


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp, leaving nulls null (``least``/``greatest`` alone would replace them by the bound)."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNotNull(), out)


def clip100(c: Column | str) -> Column:
    return clip(c, 0.0, 100.0)


def rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def weighted_score(parts: Mapping[str, Column | str], weights: Mapping[str, float], clamp: bool = True) -> Column:
    """Sum of weight x part, each part clamped to 0..100 unless told otherwise; unweighted names count nothing."""
    total = dbl(0.0)
    for name, part in parts.items():
        value = clip100(col(part).cast("double")) if clamp else col(part)
        total = total + dbl(weights.get(name, 0.0)) * value
    return total


def score_class(score: Column | str, bands: Sequence[tuple[str, float]] = S.CLASS_BANDS) -> Column:
    score = col(score)
    out = None
    for label, floor in bands[:-1]:
        out = F.when(score >= floor, label) if out is None else out.when(score >= floor, label)
    return out.otherwise(bands[-1][0])


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that gives null, not an error, on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def share(cond: Column) -> Column:
    """Mean of a condition over a group; a null comparison counts as false, as it does in the source data model."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def count_if(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def log_count(c: Column | str) -> Column:
    return F.log1p(col(c).cast("double"))


def severe_weather(weather: Column | str, precip_mm: Column | str, temp_c: Column | str) -> Column:
    flag = col(weather).isin("snow", "storm") | (col(precip_mm) > 10) | (col(temp_c) < 0)
    return F.coalesce(flag, F.lit(False)).cast("int")


def percent(c: Column | str, digits: int | None = 1) -> Column:
    return rounded(col(c) * dbl(100.0), digits)


def canonical_key(c: Column | str) -> Column:
    """Human label -> key: trimmed, lower case, blanks and dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(col(c))), "[ -]", "_")


def template(text: str, **parts: Column | str) -> Column:
    """printf-style template; ``%s``/``%d``/``%.1f`` slots are filled from ``parts`` in order."""
    return F.format_string(text, *[col(p) for p in parts.values()])


def delay_score(avg_delay: Column | str, t: S.Thresholds = S.DEFAULTS) -> Column:
    return clip100(dbl(100.0) - col(avg_delay) * dbl(100.0 / t.delay_scale))


def date_text(c: Column | str) -> Column:
    return col(c).cast("string")
