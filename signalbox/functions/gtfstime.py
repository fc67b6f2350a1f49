"""Service-day and timetable-time expressions.

A service day is not a calendar day: timetable times run past 24:00:00, are counted
from local noon minus twelve hours, and an instant before the local boundary hour
still belongs to the previous date.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
ZONE = "Australia/Melbourne"
DAY_BOUNDARY_HOUR = 3
GTFS_TIME_PATTERN = r"^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$"
# (band, first local hour, first local hour after it)
TIME_BANDS = (("overnight", 0, 7), ("am_peak", 7, 9), ("midday", 9, 16), ("pm_peak", 16, 18), ("evening", 18, 24))
RANGE_NAMES = ("today", "yesterday", "last7", "last30", "custom")


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def gtfs_seconds(text: Column | str, strict: bool = False) -> Column:
    """``HH:MM:SS`` (hours may pass 24) to elapsed seconds; malformed is null, or an error when strict."""
    trimmed = F.trim(_c(text))

    def parse(t: Column) -> Column:
        hours, upto_minutes, seconds = F.substring_index(t, ":", 1), F.substring_index(t, ":", 2), F.substring_index(t, ":", -1)
        parts = (hours.try_cast("bigint"), F.substring_index(upto_minutes, ":", -1).try_cast("bigint"), seconds.try_cast("bigint"))
        return F.when(t.rlike(GTFS_TIME_PATTERN), parts[0] * 3600 + parts[1] * 60 + parts[2])

    # a filter on the result repeats the text's own expression wherever it is named: it is named once
    parsed = F.get(F.transform(F.array(trimmed), parse), 0)
    if not strict:
        return parsed
    return F.when(parsed.isNotNull(), parsed).when(
        trimmed.isNotNull(),
        F.raise_error(F.concat(F.lit("timetable time must be hours:minutes:seconds, got "), trimmed)).cast("bigint"),
    )


def gtfs_text(seconds: Column | str) -> Column:
    """Elapsed seconds back to ``HH:MM:SS``."""
    s = _c(seconds).cast("bigint")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", pad(F.floor(s / 3600)), pad(F.floor((s % 3600) / 60)), pad(s % 60))


def _local_instant(day: Column, hour: int, zone: str) -> Column:
    return F.make_timestamp(
        F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(0), F.lit(0), F.lit(zone)
    )


def service_day_start(day: Column | str, zone: str = ZONE) -> Column:
    """UTC instant of local noon minus twelve hours (unambiguous on clock-change days)."""
    return _local_instant(_c(day), 12, zone) - F.expr("INTERVAL 12 HOURS")


def add_seconds(instant: Column, seconds: Column | str) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) + _c(seconds).cast("bigint") * 1_000_000)


def scheduled_instant(day: Column | str, seconds: Column | str, zone: str = ZONE) -> Column:
    """Absolute instant of a timetable time given in elapsed seconds."""
    return add_seconds(service_day_start(day, zone), seconds)


def scheduled_instant_of(day: Column | str, text: Column | str, zone: str = ZONE) -> Column:
    """Absolute instant of a timetable time given as text."""
    return scheduled_instant(day, gtfs_seconds(text), zone)


def local_time(instant: Column | str, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(_c(instant), zone)


def local_hour(instant: Column | str, zone: str = ZONE) -> Column:
    return F.hour(local_time(instant, zone))


def service_date(instant: Column | str, zone: str = ZONE, boundary_hour: int = DAY_BOUNDARY_HOUR) -> Column:
    """Service day an observed instant belongs to."""
    local = local_time(instant, zone)
    return F.date_sub(F.to_date(local), F.when(F.hour(local) < boundary_hour, 1).otherwise(0))


def service_date_boundary(day: Column | str, zone: str = ZONE, boundary_hour: int = DAY_BOUNDARY_HOUR) -> Column:
    """UTC instant at which a service day begins to accept observations."""
    return _local_instant(_c(day), boundary_hour, zone)


def parse_start_date(text: Column | str) -> Column:
    """Feed ``YYYYMMDD`` to a date; malformed is null."""
    value = _c(text)
    return F.when(value.rlike("^[0-9]{8}"), F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd"))


def resolve_service_date(start_date: Column | str, now: Column) -> Column:
    """The feed's own start date when readable, else the service day of ``now``."""
    return F.coalesce(parse_start_date(start_date), service_date(now))


def is_overnight(instant: Column | str, first: int = 0, until: int = 7, zone: str = ZONE) -> Column:
    hour = local_hour(instant, zone)
    return (hour >= first) & (hour < until)


def time_band(hour: Column | str) -> Column:
    """Name of the band a local hour falls in."""
    h = _c(hour)
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(TIME_BANDS):
        out = F.when((h >= lo) & (h < hi), F.lit(name)).otherwise(out)
    return out


# --- driver-side date arithmetic for request parameters (a handful of scalars) ---


def service_date_of(now: datetime, zone: str = ZONE, boundary_hour: int = DAY_BOUNDARY_HOUR) -> date:
    if now.tzinfo is None:
        raise ValueError("an instant needs a time zone")
    local = now.astimezone(ZoneInfo(zone))
    return local.date() - timedelta(days=1 if local.hour < boundary_hour else 0)


class RangeError(ValueError):
    """The requested range cannot be resolved."""


def resolve_range(
    name: str, now: datetime, start: date | None = None, end: date | None = None
) -> tuple[list[date], int]:
    """Requested service dates, oldest first, and how many the caller asked for.

    Never reaches past the current service day; the expected length still counts
    the days that were cut off.
    """
    today = service_date_of(now)
    rolling = {"today": (0, 1), "yesterday": (1, 1), "last7": (0, 7), "last30": (0, 30)}
    if name in rolling:
        lag, length = rolling[name]
        newest = today - timedelta(days=lag)
        return [newest - timedelta(days=back) for back in range(length - 1, -1, -1)], length
    if name != "custom":
        raise RangeError(f"unknown range {name!r}; one of {RANGE_NAMES}")
    if start is None or end is None:
        raise RangeError("a custom range needs a start and an end")
    if start > end:
        raise RangeError("a custom range must not start after it ends")
    usable = (min(end, today) - start).days + 1
    return [start + timedelta(days=i) for i in range(max(usable, 0))], (end - start).days + 1


def latest_week_boundary(instant: Column | str, hour: int = 8, zone: str = ZONE) -> Column:
    """Local date of the latest Monday whose ``hour`` o'clock is not after the instant."""
    local = local_time(instant, zone)
    monday = F.to_date(F.date_trunc("week", local))
    early = (F.to_date(local) == monday) & (F.hour(local) < hour)
    return F.date_sub(monday, F.when(early, 7).otherwise(0))
