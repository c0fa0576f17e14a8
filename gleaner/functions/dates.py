"""Times: epoch seconds or milliseconds, look-back windows, month buckets. Session time zone; UTC where results are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Seconds of a timestamp with or without zone, with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def from_epoch(x: Column, milliseconds_from: float = 1e12) -> Column:
    """A timestamp from seconds, or from milliseconds where the number is greater than the bound."""
    return F.timestamp_seconds(F.when(x > milliseconds_from, x / 1000).otherwise(x))


def add_months(ts: Column, months: int) -> Column:
    """Calendar months later (or earlier), where a day that the month lacks runs over into the next: 30 April less 2 months is 1 March in a leap year."""
    day = F.date_add(F.add_months(F.trunc(ts, "MM"), months), F.day(ts) - 1)
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + F.unix_timestamp(ts) - F.unix_timestamp(F.date_trunc("DAY", ts)))


PRESETS = {"7d": (7, "day"), "30d": (30, "day"), "60d": (60, "day"), "2m": (2, "month")}


def window_since(now: Column, preset: str | None = None, value: int = 0, unit: str = "") -> Column:
    """Epoch second at which a look-back window begins; 0, which filters nothing, for windows that aren't valid."""
    if preset == "today":
        return F.unix_timestamp(F.date_trunc("DAY", now))
    if preset:
        value, unit = PRESETS.get(preset, (0, ""))
    if value <= 0 or unit not in ("day", "month", "year"):
        return F.lit(0).cast("long")
    if unit == "day":
        return F.unix_timestamp(F.timestamp_seconds(F.unix_timestamp(now) - value * 86400))
    return F.unix_timestamp(add_months(now, -value * (12 if unit == "year" else 1)))


def since_filter(ts: Column, since: Column) -> Column:
    """True from `since` on; missing, invalid and non-positive times pass, and so does everything if since is not positive."""
    return (since <= 0) | (F.coalesce(ts, F.lit(0.0)) <= 0) | (ts >= since)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
