"""Durations and time stamps. A time without a zone is UTC, whatever the session zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import fixed_text


def poll_interval_seconds(interval: Column) -> Column:
    """``30s``, ``5m`` or ``1h`` in seconds, else NULL."""
    lowered = F.lower(interval)
    amount = F.regexp_extract(lowered, r"^(\d+)[smh]$", 1).try_cast("bigint")
    unit = F.right(lowered, F.lit(1))
    return amount * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)


ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_time(value: Column) -> Column:
    """ISO text, extended or compact, or epoch seconds (9 digits or more) as a timestamp; NULL where neither.

    A part of the clock that is left out is 0.
    """
    epoch = F.timestamp_seconds(F.when(value.rlike(r"^\d{9,12}$"), value).try_cast("bigint"))

    def part(n: int, otherwise: str) -> Column:
        found = F.regexp_extract(value, ISO, n)
        return F.when(found == "", otherwise).otherwise(found)

    clock = F.concat(part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.translate(part(7, ""), ",", "."))
    iso = F.concat(part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit("T"), clock, part(8, "Z"))
    return F.coalesce(epoch, F.try_to_timestamp(F.when(value.rlike(ISO), iso)))


def utc_clock(moment: Column) -> Column:
    """The UTC wall clock of a timestamp, free of any zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


def format_time(value: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Text in ``zone``; ``N/A`` for a missing or unreadable time."""
    clock = utc_clock(parse_time(value))
    if zone != "UTC":
        clock = F.convert_timezone(F.lit("UTC"), F.lit(zone), clock)
    return F.coalesce(F.date_format(clock, pattern), F.lit("N/A"))


def completion_time(start: Column, minutes: Column) -> Column:
    """Start plus minutes, followed by the zone if the start named one; else ``Unknown``."""
    clock = utc_clock(parse_time(start)) + F.make_dt_interval(mins=minutes)
    zone = F.when(start.rlike(ZONE), "UTC").otherwise("")
    return F.coalesce(F.concat(F.date_format(clock, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), zone), F.lit("Unknown"))


def elapsed_text(seconds: Column) -> Column:
    seconds = seconds.cast("double")
    return (
        F.when(seconds < 60, F.concat(fixed_text(seconds, 1), F.lit(" seconds")))
        .when(seconds < 3600, F.concat(fixed_text(seconds / 60, 1), F.lit(" minutes")))
        .otherwise(F.concat(fixed_text(seconds / 3600, 1), F.lit(" hours")))
    )


def older_than(created_at: Column, as_of: Column, days: int = 30) -> Column:
    """Strictly older than ``days``. An unreadable time is kept, so it is not old."""
    age = F.unix_micros(as_of) - F.unix_micros(parse_time(created_at))
    return F.coalesce(age > days * 86_400 * 1_000_000, F.lit(False))


def stable_id(prefix: str, created: Column, key: Column) -> Column:
    """``prefix_epoch_12hex``. Derived from the row's key, so a rerun gives the same id."""
    return F.concat_ws("_", F.lit(prefix), F.unix_seconds(created), F.substring(F.md5(F.encode(key, "UTF-8")), 1, 12))
