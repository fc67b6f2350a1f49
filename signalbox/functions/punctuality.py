"""Punctuality, percentage, badge and naming expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
ON_TIME_MAX_S = 299
LATE_10_MIN_S = 600
STATUSES = ("on_time", "late", "cancelled", "undetermined_gap")
REPLACEMENT_SHORT_NAME = "Replacement Bus"
REPLACEMENT_SUFFIX = "-R:"
STATION_SUFFIX = " Railway Station"
BADGE_BAND_S = 60
PERMANENT_GAP_DAYS = 53


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def punctuality_status(delay: Column | str, on_time_max: int = ON_TIME_MAX_S) -> Column:
    """Early or at most ``on_time_max`` seconds late is on time."""
    return F.when(_c(delay) <= on_time_max, F.lit("on_time")).when(_c(delay).isNotNull(), F.lit("late"))


def terminus_delay(feed_delay: Column, actual: Column, scheduled: Column) -> Column:
    """The feed's own delay, else whole seconds between actual and scheduled, cut toward zero."""
    difference = (F.unix_micros(actual) - F.unix_micros(scheduled)) / 1_000_000
    return F.coalesce(feed_delay.cast("int"), difference.cast("int"))


def percent_on_time(on_time: Column, late: Column) -> Column:
    ran = on_time + late
    return F.when(ran > 0, on_time * 100.0 / ran).otherwise(F.lit(0.0))


def replacement_route_id(route_id: Column | str) -> Column:
    return F.concat(F.regexp_replace(_c(route_id), ":+$", ""), F.lit(REPLACEMENT_SUFFIX))


def is_replacement(short_name: Column | str) -> Column:
    """An unknown route is not a replacement."""
    return F.coalesce(_c(short_name) == REPLACEMENT_SHORT_NAME, F.lit(False))


def station_display_name(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), STATION_SUFFIX + "$", "")


def has_digest_data(on_time: Column, late: Column) -> Column:
    return (on_time + late) > 0


def js_round_minutes(seconds: Column) -> Column:
    """Minutes rounded with halves going up (toward positive infinity)."""
    return F.floor(seconds / 60.0 + 0.5).cast("bigint")


def schedule_badge(cancelled: Column, added: Column, live: Column, delay: Column) -> Column:
    minutes = js_round_minutes(delay).cast("string")
    return (
        F.when(cancelled, "Cancelled")
        .when(added, "Extra service")
        .when(~live, "Scheduled")
        .when(delay.isNull() | (F.abs(delay) <= BADGE_BAND_S), "On time")
        .when(delay > 0, F.concat(F.lit("+"), minutes, F.lit(" min")))
        .otherwise(F.concat(minutes, F.lit(" min early")))
    )


def is_permanent_gap(day: Column, today: Column, safety_net_days: int = PERMANENT_GAP_DAYS) -> Column:
    return F.datediff(today, day) > safety_net_days
