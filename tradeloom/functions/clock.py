"""Time-of-day, session and zone expressions over naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR_ZONE = "America/Chicago"
EXCHANGE_ZONE = "America/New_York"
SECONDS_PER_YEAR = 365.25 * 86400.0


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_masks(minute: Column) -> dict[str, Column]:
    """Named masks over minute of day: regular hours, overnight, after hours, lunch."""
    return {
        "rth": (minute >= 570) & (minute < 960),
        "overnight": (minute >= 1080) | (minute < 570),
        "post_rth": (minute >= 960) & (minute < 1080),
        "lunch": (minute >= 720) & (minute < 840),
    }


def session_ok(hour: Column, mode: Column) -> Column:
    """Entry-hour filter by mode: 0 none, 1 day, 2 core, anything else overnight."""
    return (
        F.when(mode == 0, F.lit(True))
        .when(mode == 1, (hour >= 7) & (hour < 20))
        .when(mode == 2, (hour >= 9) & (hour < 16))
        .otherwise((hour >= 20) | (hour < 7))
    )


def hhmm(ts: Column) -> Column:
    return F.hour(ts) * 100 + F.minute(ts)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def to_exchange_zone(ts_ntz: Column) -> Column:
    """Naive bar-zone time as naive exchange-zone time."""
    return F.convert_timezone(F.lit(BAR_ZONE), F.lit(EXCHANGE_ZONE), ts_ntz)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def years_between(first: Column, last: Column) -> Column:
    return (epoch_seconds(last) - epoch_seconds(first)) / SECONDS_PER_YEAR
