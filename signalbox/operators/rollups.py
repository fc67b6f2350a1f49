"""Daily, hourly and weekly punctuality rollups and the series derived from them.

Completion events carry ``service_date, trip_id, route_id, status, delay_seconds,
actual_at``.  Every rollup counts per (day, route) first, with map-side partial
aggregation, and only then meets the route table, so a line holding most of the rows
costs one small record per day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.gtfstime import local_hour
from signalbox.functions.punctuality import (
    LATE_10_MIN_S,
    is_replacement,
    percent_on_time,
    replacement_route_id,
)

LINE_COUNTS = ("on_time_count", "late_count", "cancelled_count", "gap_count", "replacement_bus_count")
HISTOGRAM_COUNTS = ("on_time_count", "late_5_10_count", "late_10_plus_count", "cancelled_count", "gap_count")
MIN_LINE_SAMPLE = 20  # fixed value: runs a line needs before its percentage is shown


def _is(status: str) -> Column:
    return F.col("status") == status


def first_completions(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Earliest event per (service_date, trip_id) in recording order."""
    keys = ["service_date", "trip_id"]
    rest = [c for c in events.columns if c not in keys]
    picked = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return picked.select(*keys, "_e.*")


def flag_replacement(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``is_bus``; unknown routes are real lines."""
    return df.join(routes.select("route_id", is_replacement("short_name").alias("is_bus")), "route_id", "left").withColumn(
        "is_bus", F.coalesce("is_bus", F.lit(False))
    )


def real_line_events(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events of a known or unknown route that is not a bus replacement."""
    return flag_replacement(events.filter(F.col("route_id").isNotNull()), routes).filter(~F.col("is_bus")).drop("is_bus")


def _counts(*pairs: tuple[str, Column]) -> list[Column]:
    return [F.count_if(cond).alias(name) for name, cond in pairs]


def line_day_rollup(first_events: DataFrame, routes: DataFrame) -> DataFrame:
    """Status counts per (day, line), with the volume of the line's bus replacement beside them.

    Expects one event per trip and day.  Replacement routes get no row of their own.
    """
    per_route = (
        first_events.filter(F.col("route_id").isNotNull())
        .groupBy("service_date", "route_id")
        .agg(
            *_counts(
                ("on_time_count", _is("on_time")),
                ("late_count", _is("late")),
                ("cancelled_count", _is("cancelled")),
                ("gap_count", _is("undetermined_gap")),
            )
        )
    )
    volume = F.col("on_time_count") + F.col("late_count") + F.col("cancelled_count") + F.col("gap_count")
    buses = per_route.select("service_date", F.col("route_id").alias("bus_id"), volume.alias("replacement_bus_count"))
    lines = flag_replacement(per_route, routes).filter(~F.col("is_bus")).withColumn(
        "bus_id", replacement_route_id("route_id")
    )
    return lines.join(buses, ["service_date", "bus_id"], "left").select(
        "service_date", "route_id", *LINE_COUNTS[:4],
        F.coalesce("replacement_bus_count", F.lit(0)).alias("replacement_bus_count"),
    )


def hour_day_rollup(first_events: DataFrame, routes: DataFrame) -> DataFrame:
    """Arrivals per (day, line, local hour), plus the network total as a null line."""
    per_route = (
        first_events.filter(F.col("route_id").isNotNull() & F.col("actual_at").isNotNull())
        .groupBy("service_date", "route_id", local_hour("actual_at").cast("bigint").alias("hour_local"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    day, route, hour = F.col("service_date"), F.col("route_id"), F.col("hour_local")
    return (
        flag_replacement(per_route, routes).filter(~F.col("is_bus"))
        .groupingSets([[day, route, hour], [day, hour]], day, route, hour)
        .agg(F.sum("n").alias("completion_count"))
    )


def histogram_day_rollup(first_events: DataFrame, routes: DataFrame) -> DataFrame:
    """Delay buckets per day over real lines; a day with events always has a row."""
    very_late = F.coalesce("delay_seconds", F.lit(0)) >= LATE_10_MIN_S
    per_route = first_events.groupBy("service_date", "route_id").agg(
        *_counts(
            ("on_time_count", _is("on_time")),
            ("late_5_10_count", _is("late") & ~very_late),
            ("late_10_plus_count", _is("late") & very_late),
            ("cancelled_count", _is("cancelled")),
            ("gap_count", _is("undetermined_gap")),
        )
    )
    counted = flag_replacement(per_route, routes)
    real = F.col("route_id").isNotNull() & ~F.col("is_bus")
    return counted.groupBy("service_date").agg(
        *[F.sum(F.when(real, F.col(c)).otherwise(0)).alias(c) for c in HISTOGRAM_COUNTS]
    )


# --- reading a range of days back ---


def in_days(df: DataFrame, days: Sequence[date], column: str = "service_date") -> DataFrame:
    """Keep the requested days; a gapless list becomes a range the scan can prune on."""
    if not days:
        return df.filter(F.lit(False))
    ordered = sorted(set(days))
    if (ordered[-1] - ordered[0]).days + 1 == len(ordered):
        return df.filter(F.col(column).between(F.lit(ordered[0]), F.lit(ordered[-1])))
    return df.filter(F.col(column).isin(ordered))


def day_spine(spark, days: Sequence[date]) -> DataFrame:
    """One row per requested day."""
    ordered = sorted(set(days))
    if not ordered:
        return spark.createDataFrame([], "service_date date")
    whole = F.sequence(F.lit(ordered[0]), F.lit(ordered[-1]), F.expr("INTERVAL 1 DAY"))
    return in_days(spark.range(1).select(F.explode(whole).alias("service_date")), ordered)


def sum_lines(line_days: DataFrame, days: Sequence[date]) -> DataFrame:
    return in_days(line_days, days).groupBy("route_id").agg(*[F.sum(c).alias(c) for c in LINE_COUNTS])


def sum_hours(hour_days: DataFrame, days: Sequence[date]) -> DataFrame:
    return (
        in_days(hour_days, days).groupBy("route_id", "hour_local").agg(F.sum("completion_count").alias("completion_count"))
    )


def sum_histogram(histogram_days: DataFrame, days: Sequence[date]) -> DataFrame:
    return in_days(histogram_days, days).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in HISTOGRAM_COUNTS])


def range_coverage(line_days: DataFrame, meta: DataFrame, days: Sequence[date]) -> DataFrame:
    """Per requested day: whether any line row exists and when its rollup was generated."""
    covered = in_days(line_days, days).groupBy("service_date").agg(F.count(F.lit(1)).alias("lines"))
    spine = day_spine(line_days.sparkSession, days)
    return (
        spine.join(covered, "service_date", "left")
        .join(meta.select("service_date", "generated_at"), "service_date", "left")
        .select("service_date", F.col("lines").isNotNull().alias("is_covered"), "generated_at")
    )


def network_kpi(line_days: DataFrame) -> DataFrame:
    sums = line_days.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LINE_COUNTS[:4]])
    return sums.select(
        percent_on_time(F.col("on_time_count"), F.col("late_count")).alias("on_time_pct"),
        (F.col("on_time_count") + F.col("late_count") + F.col("cancelled_count") + F.col("gap_count")).alias("total"),
        F.col("cancelled_count").alias("cancelled"),
        F.col("gap_count").alias("gap"),
    )


def daily_series(line_days: DataFrame, days: Sequence[date]) -> DataFrame:
    """One row per requested day, zero and flagged where no rollup exists."""
    daily = in_days(line_days, days).groupBy("service_date").agg(
        *[F.sum(c).alias(c) for c in LINE_COUNTS[:4]], F.lit(True).alias("has_data")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return day_spine(line_days.sparkSession, days).join(daily, "service_date", "left").select(
        "service_date", *[zero(c) for c in LINE_COUNTS[:4]], F.coalesce("has_data", F.lit(False)).alias("has_data")
    )


def weekday_weekend(series: DataFrame) -> DataFrame:
    weekend = F.weekday("service_date") >= 5
    ran = F.col("on_time_count") + F.col("late_count")
    grouped = series.groupBy(F.when(weekend, "weekend").otherwise("weekday").alias("day_type")).agg(
        F.sum("on_time_count").alias("on_time_count"), F.sum(ran).alias("ran")
    )
    late = F.col("ran") - F.col("on_time_count")
    return grouped.select(
        "day_type", "on_time_count", "ran", percent_on_time(F.col("on_time_count"), late).alias("on_time_pct"),
        (F.col("ran") > 0).alias("has_data"),
    )


def hour_series(hour_sums: DataFrame) -> DataFrame:
    """Network arrivals for each of the 24 local hours, explicit zeros included."""
    network = hour_sums.filter(F.col("route_id").isNull()).select("hour_local", "completion_count")
    return (
        hour_sums.sparkSession.range(24).withColumnRenamed("id", "hour_local").join(network, "hour_local", "left")
        .select("hour_local", F.coalesce("completion_count", F.lit(0)).alias("completion_count"))
    )


def busiest_lines(line_sums: DataFrame, min_sample: int = MIN_LINE_SAMPLE) -> DataFrame:
    ran = F.col("on_time_count") + F.col("late_count")
    return line_sums.select("route_id", ran.alias("ran"), (ran < min_sample).alias("low_sample")).orderBy(
        F.desc("ran"), "route_id"
    )


# --- weekly digest: raw events, no per-trip dedupe, replacement routes included ---


def _week(day: str = "service_date") -> Column:
    return F.to_date(F.date_trunc("week", F.col(day)))


def _weekly_route_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(_week().alias("week_start"), "service_date", "route_id").agg(
        *_counts(
            ("on_time_count", _is("on_time")), ("late_count", _is("late")), ("cancelled_count", _is("cancelled"))
        )
    )


def weekly_network_stats(events: DataFrame) -> DataFrame:
    """Totals per Monday-based week; gaps are left out, null routes are kept."""
    sums = _weekly_route_counts(events).groupBy("week_start", "service_date").agg(
        *[F.sum(c).alias(c) for c in LINE_COUNTS[:3]]
    ).groupBy("week_start").agg(
        *[F.sum(c).alias(c) for c in LINE_COUNTS[:3]], F.count(F.lit(1)).alias("days_covered")
    )
    return sums.select(
        "week_start", F.date_add("week_start", 6).alias("week_end"), "days_covered", *LINE_COUNTS[:3],
        percent_on_time(F.col("on_time_count"), F.col("late_count")).alias("on_time_pct"),
    )


def weekly_line_stats(events: DataFrame, min_sample: int = MIN_LINE_SAMPLE) -> DataFrame:
    """Lines with enough runs, best first within a week."""
    sums = (
        _weekly_route_counts(events).filter(F.col("route_id").isNotNull())
        .groupBy("week_start", "route_id").agg(*[F.sum(c).alias(c) for c in LINE_COUNTS[:3]])
        .withColumn("trip_count", F.col("on_time_count") + F.col("late_count"))
        .filter(F.col("trip_count") >= min_sample)
    )
    return sums.withColumn("on_time_pct", percent_on_time(F.col("on_time_count"), F.col("late_count"))).orderBy(
        "week_start", F.desc("on_time_pct"), "route_id"
    )


def latest_digests(digests: DataFrame, line_stats: DataFrame, limit: int = 20) -> DataFrame:
    """Newest digests with their line rows; the limit is part of the listing."""
    newest = digests.orderBy(F.desc("week_start")).limit(limit)
    lines = line_stats.select("week_start", "route_id", "trip_count", F.col("on_time_pct").alias("line_on_time_pct"))
    return newest.join(lines, "week_start", "left").orderBy(F.desc("week_start"), "route_id")
