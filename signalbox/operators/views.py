"""Current-state views that put lifecycle, feeds and timetable side by side, one row per trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.operators.alerts import alerts_for_line
from signalbox.operators.lifecycle import MAX_GHOST_AGE_S, ghost_duration_so_far, is_current
from signalbox.operators.schedule import routes_by_name
from signalbox.functions.punctuality import replacement_route_id
from signalbox.operators.station import next_stop, progress_sequence


def current_trains(
    tracked: DataFrame, snapshots: DataFrame, static: DataFrame, stops: DataFrame, termini: DataFrame,
    skips: DataFrame, now_s: Column,
) -> DataFrame:
    """Every tracked trip with what is known about it.

    A trip that left both feeds keeps its last position and has no route.  Progress is
    given only together with a known terminus.  ``static``: trip_id, headsign,
    direction_id; ``termini``: trip_id, terminus_sequence; ``skips``: trip_id,
    skipped_stop_count.
    """
    live = snapshots.select(
        "trip_id", "route_id", "lat", "lon", F.lit(True).alias("_live"),
        next_stop(F.col("stop_time_updates"), now_s).alias("_next"),
        progress_sequence(F.col("stop_time_updates"), now_s).alias("_progress"),
    )
    names = stops.select(F.col("stop_id").alias("next_stop_id"), F.col("name").alias("next_stop_name"))
    joined = (
        tracked.join(live, "trip_id", "left").join(static, "trip_id", "left").join(termini, "trip_id", "left")
        .join(skips, "trip_id", "left").withColumn("next_stop_id", F.col("_next.next_stop_id"))
        .join(names, "next_stop_id", "left")
    )
    seen = F.col("_live").isNotNull()
    known = seen & F.col("terminus_sequence").isNotNull() & F.col("_progress").isNotNull()
    return joined.select(
        "trip_id", "status", F.when(seen, F.col("route_id")).alias("route_id"),
        F.when(seen, F.col("lat")).otherwise(F.col("last_lat")).alias("lat"),
        F.when(seen, F.col("lon")).otherwise(F.col("last_lon")).alias("lon"),
        "last_seen_at", "last_touched_at", F.nullif("headsign", F.lit("")).alias("headsign"), "direction_id",
        "next_stop_id", "next_stop_name", F.col("_next.next_stop_delay").alias("next_stop_delay_seconds"),
        F.when(known, F.col("_progress")).alias("progress_stop_sequence"),
        F.when(known, F.col("terminus_sequence")).alias("progress_total_stops"),
        F.when(seen, F.col("skipped_stop_count")).alias("skipped_stop_count"),
    )


def network_state(
    trains: DataFrame, feeds: DataFrame, backoff: DataFrame, now_s: Column, max_age_s: float = MAX_GHOST_AGE_S
) -> dict[str, DataFrame]:
    """Trains worth showing, feed freshness and the backoff flag of the latest cycle."""
    latest = backoff.agg(F.max_by("backoff", "at").alias("backoff_active"))
    return {"trains": trains.filter(is_current(now_s, max_age_s)), "feeds": feeds, "backoff": latest}


def trip_details(snapshots: DataFrame, tracked: DataFrame, now_s: Column) -> DataFrame:
    """Each trip either side knows: where its position comes from, cancellation, evidence of a ghost."""
    live = snapshots.select("trip_id", "route_id", "relationship", "lat", "lon", "stop_time_updates",
                            F.lit(True).alias("_live"))
    joined = live.join(tracked, "trip_id", "full")
    has_live, has_last = F.col("lat").isNotNull(), F.col("last_seen_at").isNotNull()
    pick = lambda a, b: F.when(has_live, F.col(a)).when(has_last, F.col(b))
    return joined.select(
        "trip_id", "status", F.when(has_live, "live").when(has_last, "last_confirmed").alias("position_source"),
        pick("lat", "last_lat").alias("latitude"), pick("lon", "last_lon").alias("longitude"), "route_id",
        F.when(F.col("_live"), F.equal_null("relationship", F.lit("CANCELED"))).alias("is_cancelled"),
        F.when(F.col("_live"), F.equal_null("relationship", F.lit("ADDED"))).alias("is_added"),
        F.coalesce("stop_time_updates", F.array()).alias("stops"), "last_seen_at",
        ghost_duration_so_far(now_s).alias("ghost_duration_s"),
    )


def line_route_ids(routes: DataFrame, name: str) -> DataFrame:
    found = routes_by_name(routes, name)
    return found.select("route_id").unionByName(
        found.select(replacement_route_id("route_id").alias("route_id"))
    ).distinct()


def line_trips(snapshots: DataFrame, tracked: DataFrame, routes: DataFrame, name: str, now_s: Column) -> DataFrame:
    """Trips of the latest merge on a named line, with their status and ghost evidence."""
    mine = snapshots.join(line_route_ids(routes, name), "route_id", "left_semi")
    return mine.join(tracked, "trip_id", "left").select(
        "trip_id", "route_id", "status", "last_seen_at", ghost_duration_so_far(now_s).alias("ghost_duration_s"),
        F.equal_null("relationship", F.lit("CANCELED")).alias("is_cancelled"),
    )


def line_status(
    snapshots: DataFrame, tracked: DataFrame, alerts: DataFrame, routes: DataFrame, name: str, now_s: Column, now: Column
) -> dict[str, DataFrame]:
    """Counts by status, evidence for trips that are not live, cancelled trips and the line's alerts."""
    trips = line_trips(snapshots, tracked, routes, name, now_s)
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return {
        "counts": trips.agg(is_("live"), is_("coasting"), is_("ghost")),
        "not_live": trips.filter(F.col("status").isin("coasting", "ghost")).select(
            "trip_id", "status", "last_seen_at", "ghost_duration_s"),
        "cancelled": trips.filter("is_cancelled").select("trip_id"),
        "alerts": alerts_for_line(alerts, routes, name, now),
    }


def station_board(departures: DataFrame, headways: DataFrame, stops: DataFrame) -> DataFrame:
    """Departures with the headway of their platform, line and direction and the station's wheelchair flag."""
    flags = stops.select(F.col("stop_id").alias("station_id"), "wheelchair")
    return departures.join(headways, ["stop_id", "route_id", "direction_id"], "left").join(
        flags, "station_id", "left"
    ).withColumns({
        "sample_size": F.coalesce("sample_size", F.lit(0)), "gap_detected": F.coalesce("gap_detected", F.lit(False)),
    })
