"""Static-timetable operators, written for all stations, trips or days at once.

``stop_times`` carries ``trip_id, stop_sequence, stop_id, arrival_time, departure_time``
(GTFS text); ``trips`` carries ``trip_id, route_id, service_id, direction_id, headsign``;
``stops`` carries ``stop_id, parent_station, name, lat, lon, platform_code``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.geo import KM_PER_DEGREE_LAT
from signalbox.functions.gtfstime import gtfs_seconds, scheduled_instant
from signalbox.functions.punctuality import (
    REPLACEMENT_SHORT_NAME,
    REPLACEMENT_SUFFIX,
    is_replacement,
    station_display_name,
)
from signalbox.operators.ordered import ordered_scan
from signalbox.session import checkpointed

# fixed values
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
CITY_LOOP_STATIONS = ("vic:rail:FGS", "vic:rail:MCE", "vic:rail:PAR")
DEPARTURES_PER_DIRECTION = 3
BOUNDS_BUFFER_KM = 5.0
ADDED, REMOVED = 1, 2


class UnpinnedError(LookupError):
    """No timetable snapshot is pinned to the requested service date."""


# --- calendar ---


def active_services(calendar: DataFrame, calendar_dates: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """(service_date, service_id) pairs that run: weekly rule plus additions minus removals.

    The weekly rule is laid out as one row per service and valid day, which turns the
    date-range condition into an equality.  ``days`` (``service_date``) narrows the result.
    """
    flags = F.array(*[F.col(d) for d in WEEKDAYS])
    span = F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY"))
    weekly = (
        calendar.filter(F.col("start_date") <= F.col("end_date"))
        .select("service_id", flags.alias("_flags"), F.explode(span).alias("service_date"))
        .filter(F.element_at("_flags", F.weekday("service_date") + 1))
        .select("service_date", "service_id")
    )
    change = lambda kind: calendar_dates.filter(F.col("exception_type") == kind).select(
        F.col("date").alias("service_date"), "service_id"
    )
    running = (
        weekly.unionByName(change(ADDED)).distinct().join(change(REMOVED), ["service_date", "service_id"], "left_anti")
    )
    return running if days is None else running.join(days, "service_date", "left_semi")


def one_day(spark, day: date) -> DataFrame:
    return spark.range(1).select(F.lit(day).alias("service_date"))


def trips_on(trips: DataFrame, active: DataFrame) -> DataFrame:
    """Trips whose service is among the active ones (a single day's ``active``)."""
    return trips.join(active.select("service_id"), "service_id", "left_semi")


# --- pinned lookups ---


def pinned_digest(pins: DataFrame, day: date) -> str:
    row = pins.filter(F.col("service_date") == F.lit(day)).select("digest").first()
    if row is None:
        raise UnpinnedError(f"no timetable snapshot pinned to {day.isoformat()}")
    return row.digest


def pinned_dimension(dimension: DataFrame, pins: DataFrame, day: date) -> DataFrame:
    """Rows of the snapshot pinned to the day; an unpinned day is an error, not an empty answer."""
    return dimension.filter(F.col("digest") == pinned_digest(pins, day))


def trip_termini(stop_times: DataFrame, keys: Sequence[str] = ("trip_id",)) -> DataFrame:
    """Row with the greatest stop_sequence per trip; columns that are not asked for are not worked out."""
    last = lambda c: F.max_by(c, "stop_sequence")
    return stop_times.groupBy(*keys).agg(
        last(F.col("stop_id")).alias("terminus_stop_id"),
        last(F.coalesce("arrival_time", "departure_time")).alias("terminus_time"),
        F.max("stop_sequence").alias("terminus_sequence"),
    )


def pinned_terminus(requests: DataFrame, pins: DataFrame, termini: DataFrame) -> DataFrame:
    """Scheduled final stop of each (trip_id, service_date) through the date's pin; null when unresolvable.

    ``termini`` is keyed by (digest, trip_id).
    """
    found = requests.join(pins.select("service_date", "digest"), "service_date", "left").join(
        termini, ["digest", "trip_id"], "left"
    )
    arrival = scheduled_instant("service_date", gtfs_seconds("terminus_time"))
    known = F.col("terminus_time").isNotNull()
    return found.select(
        *requests.columns,
        F.when(known, F.col("terminus_stop_id")).alias("terminus_stop_id"),
        F.when(known, arrival).alias("scheduled_arrival"),
        F.when(known, F.col("terminus_sequence")).alias("terminus_sequence"),
    )


def pinned_trip_fields(requests: DataFrame, pins: DataFrame, trips: DataFrame) -> DataFrame:
    """Headsign (blank is null) and direction of each (trip_id, service_date)."""
    static = trips.select("digest", "trip_id", F.nullif("headsign", F.lit("")).alias("headsign"), "direction_id")
    return (
        requests.join(pins.select("service_date", "digest"), "service_date", "left")
        .join(static, ["digest", "trip_id"], "left").drop("digest")
    )


# --- stops, stations and routes ---


def platform_parents(stops: DataFrame) -> DataFrame:
    return stops.filter((F.col("location_type") != 1) & F.col("parent_station").isNotNull()).select(
        "stop_id", F.col("parent_station").alias("station_id")
    )


def station_platforms(stops: DataFrame) -> DataFrame:
    """(station_id, stop_id): children of a station, or the stop itself when it has none."""
    children = stops.filter(F.col("parent_station").isNotNull()).select(
        F.col("parent_station").alias("station_id"), "stop_id"
    )
    own = stops.select(F.col("stop_id").alias("station_id"), "stop_id").join(children, "station_id", "left_anti")
    return children.unionByName(own)


def stop_routes(stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """(stop_id, route_id) for platforms and for their parent stations."""
    calls = (
        stop_times.select("trip_id", "stop_id").join(trips.select("trip_id", "route_id"), "trip_id")
        .select("stop_id", "route_id").distinct()
    )
    parents = stops.filter(F.col("parent_station").isNotNull()).select("stop_id", "parent_station")
    via_parent = calls.join(parents, "stop_id").select(F.col("parent_station").alias("stop_id"), "route_id")
    return calls.unionByName(via_parent).distinct()


def lines_without_service(
    stop_route: DataFrame, stops: DataFrame, routes: DataFrame, trips_today: DataFrame
) -> DataFrame:
    """Per station, routes that call there on some day but run nowhere today."""
    calling = station_platforms(stops).join(stop_route, "stop_id").select("station_id", "route_id").distinct()
    return (
        calling.join(trips_today.select("route_id").distinct(), "route_id", "left_anti")
        .join(routes, "route_id").select("station_id", "route_id", "short_name", "long_name")
        .orderBy("station_id", "long_name", "route_id")
    )


def routes_by_name(routes: DataFrame, name: str) -> DataFrame:
    """Case-insensitive line lookup: exact short names if any, else substrings; never replacements."""
    needle = name.strip().lower()
    if not needle:
        return routes.filter(F.lit(False))
    short = F.lower("short_name")
    tier = F.when(short == needle, 0).when(F.contains(short, F.lit(needle)), 1)
    matched = routes.filter(F.col("short_name") != REPLACEMENT_SHORT_NAME).withColumn("_tier", tier).filter(
        F.col("_tier").isNotNull()
    )
    return matched.join(matched.agg(F.min("_tier").alias("_tier")), "_tier", "left_semi").drop("_tier")


def likely_lines(listed: DataFrame, stop_route: DataFrame, routes: DataFrame, key: str = "alert_id") -> DataFrame:
    """Line voted for by a majority of the listed stops, strictly ahead of the runner-up.

    ``listed`` is (key, ordinal, stop_id).  Each listed stop gives one vote per distinct
    line name calling there.
    """
    names = (
        stop_route.join(routes.filter(F.length("long_name") > 0), "route_id").select("stop_id", "long_name").distinct()
    )
    stops_listed = listed.filter(F.length("stop_id") > 0)
    sizes = stops_listed.groupBy(key).agg(F.count(F.lit(1)).alias("listed"))
    votes = stops_listed.join(names, "stop_id").groupBy(key, "long_name").agg(F.count(F.lit(1)).alias("votes"))
    # names level on votes collapse to one row, so a tie at the top shows as a count
    levels = votes.groupBy(key, "votes").agg(F.count(F.lit(1)).alias("names"), F.min("long_name").alias("long_name"))
    top = levels.groupBy(key).agg(F.max_by(F.struct("votes", "names", "long_name"), "votes").alias("_w"))
    return (
        top.join(sizes, key)
        .filter((F.col("_w.names") == 1) & (F.col("_w.votes") * 2 > F.col("listed")))
        .select(key, F.col("_w.long_name").alias("long_name"), F.col("_w.votes").alias("votes"), "listed")
    )


# --- departures ---


def scheduled_departures(
    stop_times: DataFrame, trips_today: DataFrame, stops: DataFrame, day: date, now: Column
) -> DataFrame:
    """Every call of today's trips after ``now``, once per station it belongs to."""
    seconds = gtfs_seconds(F.coalesce("departure_time", "arrival_time"))
    # today's trips are few among all dates: times are only worked out for their calls
    calls = (
        stop_times.join(trips_today.select("trip_id"), "trip_id", "left_semi").select("trip_id", "stop_id", scheduled_instant(F.lit(day), seconds).alias("scheduled_at"))
        .filter(F.col("scheduled_at") > now)
        .join(trips_today.select("trip_id", "route_id", "direction_id", "headsign"), "trip_id")
    )
    return calls.join(station_platforms(stops), "stop_id").select(
        "station_id", "trip_id", "route_id", "direction_id", "headsign", "scheduled_at", "stop_id"
    )


def top_per_direction(departures: DataFrame, limit: int = DEPARTURES_PER_DIRECTION) -> DataFrame:
    """Earliest departures per (station, direction), an unknown direction being its own group.

    The rank filter is applied on the map side first, so a busy station ships at most
    ``limit`` rows per task.
    """
    w = Window.partitionBy("station_id", "direction_id").orderBy("scheduled_at", "trip_id", "stop_id")
    return departures.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")


def soonest_per_direction(departures: DataFrame) -> DataFrame:
    """First departure per station and direction, or per headsign when the direction is unknown."""
    heading = F.coalesce(F.col("direction_id").cast("string"), F.col("headsign"))
    rest = [c for c in departures.columns if c != "station_id"]
    return (
        departures.groupBy("station_id", heading.alias("heading"))
        .agg(F.min_by(F.struct(*rest), F.struct("scheduled_at", "trip_id", "stop_id")).alias("_d"))
        .select("station_id", "heading", "_d.*")
    )


def added_departures(
    snapshots: DataFrame, stops: DataFrame, now: Column, limit: int | None = DEPARTURES_PER_DIRECTION
) -> DataFrame:
    """Realtime-only extra services per station, earliest first.

    ``snapshots``: trip_id, route_id, relationship and ``stop_time_updates`` (array of
    structs in feed order).  The first listed stop that belongs to the station counts.
    """
    extra = snapshots.filter((F.col("relationship") == "ADDED") & F.col("route_id").isNotNull())
    last_stop = F.element_at("stop_time_updates", -1)["stop_id"].alias("final_stop_id")
    calls = extra.select(
        "trip_id", "route_id", last_stop, F.posexplode("stop_time_updates").alias("_pos", "_stu")
    ).select("trip_id", "route_id", "final_stop_id", "_pos", "_stu", F.col("_stu.stop_id").alias("stop_id"))
    first_call = (
        calls.join(station_platforms(stops), "stop_id")
        .groupBy("station_id", "trip_id")
        .agg(F.min_by(F.struct("route_id", "final_stop_id", "_stu"), "_pos").alias("_m"))
    )
    at = F.coalesce("_m._stu.dep_time", "_m._stu.arr_time").try_cast("bigint")
    names = stops.select(F.col("stop_id").alias("final_stop_id"), F.col("name").alias("_name"))
    found = (
        first_call.select(
            "station_id", "trip_id", "_m.route_id", "_m.final_stop_id", F.timestamp_seconds(at).alias("scheduled_at"),
            F.col("_m._stu.stop_id").alias("stop_id"),
        )
        .filter(F.col("scheduled_at") > now)
        .join(names, "final_stop_id", "left")
        .select(
            "station_id", "trip_id", "route_id", F.lit(None).cast("int").alias("direction_id"),
            F.coalesce("_name", "final_stop_id", F.lit("Extra service")).alias("headsign"), "scheduled_at", "stop_id",
        )
    )
    if limit is None:
        return found
    w = Window.partitionBy("station_id").orderBy("scheduled_at", "trip_id")
    return found.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")


def merge_departures(scheduled: DataFrame, added: DataFrame) -> DataFrame:
    return scheduled.unionByName(added).orderBy("station_id", "scheduled_at", "trip_id")


def live_overlay(departures: DataFrame, snapshots: DataFrame, stops: DataFrame) -> DataFrame:
    """Lay the latest realtime prediction over scheduled departures (same trip, same platform)."""
    live = snapshots.select("trip_id", "relationship", "stop_time_updates", F.lit(True).alias("_live"))
    stu = F.get(F.filter("stop_time_updates", lambda s: s["stop_id"] == F.col("stop_id")), 0)
    joined = departures.join(live, "trip_id", "left").withColumn("_stu", stu).join(
        stops.select("stop_id", "platform_code"), "stop_id", "left"
    )
    delay = F.coalesce("_stu.dep_delay", "_stu.arr_delay")
    at = F.timestamp_seconds(F.coalesce("_stu.dep_time", "_stu.arr_time").try_cast("bigint"))
    shifted = F.timestamp_micros(F.unix_micros("scheduled_at") + delay.cast("bigint") * 1_000_000)
    predicted = F.coalesce(at, shifted)
    skipped = F.coalesce(F.col("_stu.relationship") == "SKIPPED", F.lit(False))
    return joined.select(
        *departures.columns,
        predicted.alias("predicted_at"),
        delay.alias("delay_seconds"),
        (predicted.isNotNull() | delay.isNotNull()).alias("is_live"),
        (F.coalesce(F.col("relationship") == "CANCELED", F.lit(False)) | skipped).alias("is_cancelled"),
        F.coalesce(F.col("relationship") == "ADDED", F.lit(False)).alias("is_added"),
        "platform_code",
    )


# --- stop patterns ---


def skip_stop_counts(
    trips: DataFrame,
    stop_times: DataFrame,
    stops: DataFrame,
    routes: DataFrame,
    loop_stations: Sequence[str] = CITY_LOOP_STATIONS,
) -> DataFrame:
    """Stops each trip leaves out against the commonest pattern of comparable trips.

    A trip's stop list is reduced to 128 bits of position/stop hashes (positions differ, so nothing cancels out) and a count in one pass
    over the calls. Stop sets are compared once per distinct pattern, through one representative trip, whose calls alone are
    read again. Ties take the lowest trip id. The calls of one trip are bounded by what a vehicle can serve in a run, so
    a trip is ranked as one partition of the window.
    """
    loop = stops.filter(F.col("parent_station").isin(*loop_stations)).select("stop_id", F.lit(True).alias("_loop"))
    running = trips.join(
        routes.filter(is_replacement("short_name")).select("route_id"), "route_id", "left_anti"
    ).select("trip_id", "route_id", "direction_id")
    calls = stop_times.select("trip_id", "stop_sequence", "stop_id").join(loop, "stop_id", "left")
    ranked = calls.withColumn("_rank", F.row_number().over(Window.partitionBy("trip_id").orderBy("stop_sequence")))
    code = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "_rank", "stop_id"))
    patterns = ranked.groupBy("trip_id").agg(
        code("a").alias("_h1"), code("b").alias("_h2"), F.count(F.lit(1)).alias("_n"),
        F.max(F.coalesce("_loop", F.lit(False))).alias("via_loop"),
        F.min_by("stop_id", "_rank").alias("first_stop"), F.max_by("stop_id", "_rank").alias("last_stop"),
    )
    group = ["route_id", "_direction", "via_loop", "first_stop", "last_stop"]
    pattern = ["_h1", "_h2", "_n"]
    # one row per trip, read several times below: materialise instead of re-ranking stop_times each time
    keyed = checkpointed(
        running.join(patterns, "trip_id").withColumn("_direction", F.coalesce("direction_id", F.lit(-1)))
        .select("trip_id", *group, *pattern)
    )
    variants = keyed.groupBy(*group, *pattern).agg(
        F.count(F.lit(1)).alias("_trips"), F.min("trip_id").alias("_sample")
    )
    # among equally common patterns the one with the lowest sample trip is normal
    ties = variants.groupBy(*group, "_trips").agg(F.min("_sample").alias("_sample"), F.sum("_trips").alias("_sum"))
    normal = ties.groupBy(*group).agg(F.max_by("_sample", "_trips").alias("_normal"), F.sum("_sum").alias("_group_trips"))
    # asked for pairs and again for the counts
    compared = checkpointed(variants.join(normal, group))
    # a group of one pattern leaves nothing out, a single trip has nothing to compare with
    pairs = checkpointed(compared.filter((F.col("_group_trips") >= 2) & (F.col("_sample") != F.col("_normal"))).select("_sample", "_normal"))
    wanted = pairs.select(F.explode(F.array("_sample", "_normal")).alias("trip_id")).distinct()
    sets = stop_times.select("trip_id", "stop_id").join(wanted, "trip_id", "left_semi").groupBy("trip_id").agg(
        F.collect_set("stop_id").alias("_stops"))  # the stops of one trip
    sets = checkpointed(sets)
    missing = pairs.join(sets.toDF("_sample", "_own"), "_sample").join(sets.toDF("_normal", "_usual"), "_normal").select(
        "_sample", F.size(F.array_except("_usual", "_own")).cast("bigint").alias("_missing"))
    skipped = compared.join(missing, "_sample", "left").select(
        *group, *pattern, F.when(F.col("_group_trips") >= 2, F.coalesce("_missing", F.lit(0).cast("bigint"))).alias("skipped_stop_count"))
    return keyed.join(skipped, [*group, *pattern]).select("trip_id", "skipped_stop_count")


def trip_id_churn(old: DataFrame, new: DataFrame) -> DataFrame:
    """Share of the old id set that survives; an empty old set is fully stable."""
    both = old.select("trip_id").distinct().withColumn("_o", F.lit(True)).join(
        new.select("trip_id").distinct().withColumn("_n", F.lit(True)), "trip_id", "full"
    )
    counts = both.agg(
        F.count("_o").alias("total_old"), F.count("_n").alias("total_new"),
        F.count_if(F.col("_o") & F.col("_n")).alias("stable"),
    )
    pct = F.when(F.col("total_old") > 0, F.col("stable") * 100.0 / F.col("total_old")).otherwise(F.lit(100.0))
    return counts.select(
        "total_old", "total_new", "stable", (F.col("total_old") - F.col("stable")).alias("churned_from_old"),
        pct.alias("stable_pct"),
    )


# --- route geometry ---


def representative_trips(trips: DataFrame, stop_times: DataFrame, tie: str = "trip_id") -> DataFrame:
    """Trip with the most stop rows per non-replacement route."""
    sizes = stop_times.groupBy("trip_id").agg(F.count(F.lit(1)).alias("_n"))
    lines = trips.filter(~F.endswith("route_id", F.lit(REPLACEMENT_SUFFIX)))
    # the lower number wins where ids are numbers, else the first in text order
    best = F.min_by(F.struct("trip_id", "shape_id", "_n"), F.struct(F.negative("_n"), F.col(tie).try_cast("bigint"), F.col(tie)))
    return lines.join(sizes, "trip_id").groupBy("route_id").agg(best.alias("_b")).select(
        "route_id", "_b.trip_id", "_b.shape_id", F.col("_b._n").alias("n_stops")
    )


def route_stations(representatives: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Stations of each route in order, consecutive repeats collapsed; ``is_dangling`` marks unknown ones."""
    calls = stop_times.join(representatives.select("route_id", "trip_id"), "trip_id").select(
        "route_id", "stop_sequence", "stop_id"
    )
    placed = calls.join(platform_parents(stops), "stop_id", "left").withColumn(
        "station_id", F.coalesce("station_id", "stop_id")
    )
    scanned = ordered_scan(
        placed, ["route_id"], ["stop_sequence"], F.floor(F.col("stop_sequence") / 1024), lags={"_before": "station_id"}
    )
    kept = scanned.filter(~F.equal_null("_before", "station_id"))
    stations = stops.filter(F.col("location_type") == 1).select(
        F.col("stop_id").alias("station_id"), station_display_name("name").alias("station_name"), "lat", "lon"
    )
    return kept.join(stations, "station_id", "left").select(
        "route_id", "stop_sequence", "station_id", "station_name", "lat", "lon",
        F.col("lat").isNull().alias("is_dangling"),
    )


def needed_shapes(shapes: DataFrame, representatives: DataFrame) -> DataFrame:
    return shapes.join(representatives.filter(F.col("shape_id").isNotNull()).select("shape_id"), "shape_id", "left_semi")


def route_lines(representatives: DataFrame, stations: DataFrame, shapes: DataFrame) -> DataFrame:
    """Drawn points per route: the representative trip's shape, or its stations when there is none."""
    drawn = representatives.select("route_id", "shape_id").join(shapes, "shape_id").select(
        "route_id", F.col("shape_pt_sequence").alias("position"), "lon", "lat", F.lit(False).alias("is_fallback")
    )
    straight = (
        stations.filter(~F.col("is_dangling")).join(drawn.select("route_id"), "route_id", "left_anti")
        .select("route_id", F.col("stop_sequence").alias("position"), "lon", "lat", F.lit(True).alias("is_fallback"))
    )
    return drawn.unionByName(straight)


def map_bounds(stations: DataFrame, buffer_km: float = BOUNDS_BUFFER_KM) -> DataFrame:
    used = stations.filter(~F.col("is_dangling")).select("station_id", "lat", "lon").distinct()
    box = used.agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"),
        F.avg("lat").alias("m"),
    )
    dlat = F.lit(buffer_km / KM_PER_DEGREE_LAT)
    dlon = F.lit(buffer_km) / (F.lit(KM_PER_DEGREE_LAT) * F.cos(F.radians("m")))
    return box.select(
        (F.col("w") - dlon).alias("west"), (F.col("e") + dlon).alias("east"),
        (F.col("s") - dlat).alias("south"), (F.col("n") + dlat).alias("north"),
    )


def routes_by_station(stations: DataFrame) -> DataFrame:
    """Sorted distinct routes per station; the set is bounded by the number of routes."""
    return (
        stations.select("station_id", "route_id").distinct()
        .groupBy("station_id").agg(F.array_sort(F.collect_set("route_id")).alias("routes"))
    )
