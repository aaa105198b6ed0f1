"""Derived values: clocks, calendars, bands, indices, geometry, bar shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- clock and calendar -----------------------------------------------------------------------


def hhmm_minutes(hhmm: Column) -> Column:
    """Minutes after midnight of an hhmm integer."""
    return F.floor(hhmm / 100).cast("int") * 60 + (hhmm % 100).cast("int")


def hhmm_to_ts(date: Column, hhmm: Column) -> Column:
    """Timestamp from a date and an hhmm integer; null where the clock is not valid (2400)."""
    clock = F.lpad(hhmm.cast("string"), 4, "0")
    text = F.concat(
        F.date_format(date, "yyyy-MM-dd"), F.lit(" "), F.substring(clock, 1, 2), F.lit(":"),
        F.substring(clock, 3, 2), F.lit(":00"),
    )
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def local_to_utc(ts: Column, zone: Column, lead_hours: int = 2) -> Column:
    """UTC instant ``lead_hours`` before a local timestamp of the given IANA zone."""
    return F.to_utc_timestamp(ts - F.expr(f"INTERVAL {lead_hours} HOURS"), zone)


def natural_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def hhmm_duration(dep: Column, arr: Column, known: Column | None = None) -> Column:
    """Scheduled minutes between two hhmm clocks, over midnight when needed. ``known`` wins."""
    minutes = F.pmod(hhmm_minutes(arr) - hhmm_minutes(dep), F.lit(1440)).cast("int")
    return minutes if known is None else F.coalesce(known, minutes)


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Hour, month, weekday (1 = Sunday) and the flags built from them."""
    hour, month, dow = F.hour(ts), F.month(ts), F.dayofweek(ts)
    return {
        "hour": hour,
        "month": month,
        "weekday": dow,
        "is_weekend": flag(dow.isin(1, 7)),
        "season": F.when(month.isin(12, 1, 2), "Winter")
        .when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .otherwise("Fall"),
        "is_peak_hour": flag(hour.between(6, 9) | hour.between(17, 20)),
        "is_peak_month": flag(month.isin(6, 7, 8, 12)),
        "is_business_hours": flag(hour.between(6, 22)),
        "is_holiday_month": flag(month.isin(11, 12, 1)),
    }


# The day parts and their hours (both ends included); night wraps around.
DAY_PARTS = {
    "early_morning": (5, 8),
    "morning": (9, 11),
    "afternoon": (12, 17),
    "evening": (18, 22),
}


def day_part(ts: Column) -> Column:
    hour = F.hour(ts)
    chain = F.when(F.lit(False), "")
    for name, (lo, hi) in DAY_PARTS.items():
        chain = chain.when(hour.between(lo, hi), name)
    return chain.otherwise("night")


def day_part_flags(ts: Column) -> dict[str, Column]:
    part = day_part(ts)
    flags = {f"is_{n}": flag(part == n) for n in [*DAY_PARTS, "night"]}
    flags["day_hour"] = F.concat_ws("_", F.dayofweek(ts), F.hour(ts))
    return flags


def cyclic_encode(c: Column, period: float, origin: float = 0) -> tuple[Column, Column]:
    angle = F.radians((c - F.lit(origin)) / F.lit(float(period)) * 360.0)
    return F.sin(angle), F.cos(angle)


def session_clock(ts: Column, open_minute: int = 570, close_minute: int = 960) -> dict[str, Column]:
    """Minutes from the open and to the close (never negative) and the share of the session."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    since = F.greatest(minute - open_minute, F.lit(0))
    return {
        "minutes_from_open": since,
        "minutes_to_close": F.greatest(F.lit(close_minute) - minute, F.lit(0)),
        "session_progress": (minute - open_minute) / F.lit(float(close_minute - open_minute)),
    }


def in_session(ts: Column, open_minute: int = 570, close_minute: int = 960) -> Column:
    """Regular hours, both ends included to the second."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return second.between(open_minute * 60, close_minute * 60)


# --- bands and categories ---------------------------------------------------------------------


def band(c: Column, edges: list[float], labels: list, right_closed: bool = False) -> Column:
    """Labelled ranges: ``len(labels) == len(edges) + 1``; an edge belongs to the range above it,
    or to the one below with ``right_closed``."""
    chain = F.when(c.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        chain = chain.when(c <= edge if right_closed else c < edge, label)
    return chain.otherwise(labels[-1])


def fixed_width_bin(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)) * F.lit(width)


def severity_index(wind: Column, rain: Column, visibility: Column) -> Column:
    """Wind + 10 x rain + (10 - visibility), missing parts taken as calm and clear."""
    return (
        F.coalesce(wind, F.lit(0.0))
        + F.coalesce(rain, F.lit(0.0)) * 10
        + (F.lit(10.0) - F.coalesce(visibility, F.lit(10.0)))
    )


# Fixed values: (visibility below, wind above, rain above) for each class.
SEVERITY_LIMITS = {"Severe": (3, 25, 0.5), "Moderate": (7, 15, 0.1)}


def severity_class(wind: Column, rain: Column, visibility: Column) -> Column:
    v, w, r = (
        F.coalesce(visibility, F.lit(10.0)),
        F.coalesce(wind, F.lit(0.0)),
        F.coalesce(rain, F.lit(0.0)),
    )
    chain = F.when(F.lit(False), "")
    for name, (vis, wnd, rn) in SEVERITY_LIMITS.items():
        chain = chain.when((v < vis) | (w > wnd) | (r > rn), name)
    return chain.otherwise("Clear")


def keyword_category(c: Column, rules: dict[str, str], default: str = "Unknown") -> Column:
    """The value of the first pattern (SQL LIKE) that matches."""
    chain = F.when(F.lit(False), "")
    for pattern, value in rules.items():
        chain = chain.when(c.like(pattern), value)
    return chain.otherwise(default)


def keyword_labels(c: Column, words: dict[str, list[str]]) -> Column:
    """Multi-label form: sorted array of every label with at least one contained word."""
    lower = F.lower(c)
    picks = [
        F.when(reduce(Column.__or__, [lower.contains(w) for w in ws]), F.lit(label))
        for label, ws in sorted(words.items())
    ]
    return F.array_compact(F.array(*picks))


def category_map(c: Column, groups: dict[str, list[str]], default: str = "Other") -> Column:
    """Many-to-one recode."""
    chain = F.when(F.lit(False), "")
    for target, members in groups.items():
        chain = chain.when(c.isin(*members), target)
    return chain.otherwise(default)


def heat_index(temp: Column, humidity: Column) -> Column:
    return F.when(temp > 70, temp + (humidity - 50) * 0.1).otherwise(temp)


def interactions(pairs: dict[str, tuple[Column, Column]], squares: dict[str, Column] | None = None,
                 decays: dict[str, tuple[Column, float]] | None = None) -> dict[str, Column]:
    """Products of pairs, squares, and ``exp(-elapsed / scale)``."""
    out = {n: a * b for n, (a, b) in pairs.items()}
    out.update({n: c * c for n, c in (squares or {}).items()})
    out.update({n: F.exp(-c / F.lit(float(k))) for n, (c, k) in (decays or {}).items()})
    return out


# --- geometry ---------------------------------------------------------------------------------

EARTH_RADIUS_KM = 6371.0088  # fixed value: mean earth radius


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (p2 - p1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def round_fast(c: Column, places: int) -> Column:
    """``round(c, places)`` of doubles, with the same results: only values below zero, beyond 2^40 or close to the
    middle between two results take the way through decimals, which costs more than a distance."""
    scaled = c * F.lit(10.0**places)
    low = F.floor(scaled)
    clear = (scaled >= 0) & (scaled < float(1 << 40)) & (F.abs(scaled - low - 0.5) > 1e-3)
    up = F.when(scaled - low > 0.5, low + 1).otherwise(low)
    return F.when(clear, up.cast("double") / F.lit(10.0**places)).otherwise(F.round(c, places))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def parse_coordinates(c: Column) -> tuple[Column, Column]:
    """``"lon, lat"`` text as ``(lat, lon)`` doubles."""
    parts = F.split(c, ",")
    lon = F.trim(F.get(parts, F.lit(0))).try_cast("double")
    lat = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return lat, lon


# --- bars -------------------------------------------------------------------------------------


def bar_shape(o: Column, h: Column, l: Column, c: Column) -> dict[str, Column]:
    """Range, signed range, wicks and position in the range, relative to the close. A flat bar has
    no signed range and no position (null)."""
    width = F.nullif(h - l, F.lit(0.0))
    close = F.nullif(c, F.lit(0.0))
    return {
        "bar_range": (h - l) / close,
        "signed_range": (c - o) / width,
        "upper_wick": (h - c) / close,
        "lower_wick": (c - l) / close,
        "range_position": (c - l) / width,
    }
