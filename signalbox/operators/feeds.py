"""From captured polls to one row per (cycle, trip): flattening, merging, discrepancies.

A capture row is one poll of one feed (see ``schemas.CAPTURE``).  ``cycle_at`` is its
fetch instant.  Duplicates inside a poll resolve to the last entity by a partial
``max_by``, so nothing is windowed or gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.geo import haversine_m
from signalbox.operators.ordered import ordered_scan
from signalbox.session import checkpointed

# fixed values
MISMATCH_FIELDS = ("route_id", "start_time", "start_date", "schedule_relationship")
VP_WITHOUT_TU = "vp_without_tu"


def epoch_instant(text: Column | str) -> Column:
    """Quoted 64-bit epoch seconds to an instant, null-safe."""
    value = F.col(text) if isinstance(text, str) else text
    return F.timestamp_seconds(value.try_cast("bigint"))


def with_cycle(captures: DataFrame) -> DataFrame:
    return captures.withColumn("cycle_at", F.to_timestamp("fetch_timestamp")).withColumn(
        "header_at", epoch_instant("feed.header.timestamp")
    )


def _last_per_trip(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != "_pos"]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_pos").alias("_e"))
    return picked.select(*keys, "_e.*")


def stop_time_updates(updates: Column) -> Column:
    """Stop updates in feed order with optional arrival/departure sides flattened."""
    one = lambda s: F.struct(
        s["stop_sequence"].alias("stop_sequence"), s["stop_id"].alias("stop_id"),
        s["schedule_relationship"].alias("relationship"),
        s["arrival"]["time"].alias("arr_time"), s["departure"]["time"].alias("dep_time"),
        s["arrival"]["delay"].alias("arr_delay"), s["departure"]["delay"].alias("dep_delay"),
    )
    return F.transform(updates, one)


def trip_updates(captures: DataFrame) -> DataFrame:
    """Schedule side of each (cycle, trip)."""
    e = with_cycle(captures).select("cycle_at", "header_at", F.posexplode("feed.entity").alias("_pos", "_e"))
    tu = F.col("_e.trip_update")
    rows = e.filter(tu.isNotNull() & tu["trip"]["trip_id"].isNotNull()).select(
        "cycle_at", tu["trip"]["trip_id"].alias("trip_id"), "_pos",
        tu["trip"]["route_id"].alias("route_id"),
        tu["trip"]["start_time"].alias("start_time"),
        tu["trip"]["start_date"].alias("start_date"),
        tu["trip"]["schedule_relationship"].alias("schedule_relationship"),
        F.coalesce(stop_time_updates(tu["stop_time_update"]), F.array()).alias("stop_time_updates"),
        F.col("header_at").alias("schedule_updated_at"),
    )
    return _last_per_trip(rows, ["cycle_at", "trip_id"])


def vehicle_positions(captures: DataFrame) -> DataFrame:
    """Position side of each (cycle, trip); the entity time falls back to the header time."""
    e = with_cycle(captures).select("cycle_at", "header_at", F.posexplode("feed.entity").alias("_pos", "_e"))
    v = F.col("_e.vehicle")
    rows = e.filter(v.isNotNull() & v["trip"]["trip_id"].isNotNull()).select(
        "cycle_at", v["trip"]["trip_id"].alias("trip_id"), "_pos",
        v["position"]["latitude"].alias("lat"), v["position"]["longitude"].alias("lon"),
        v["position"]["bearing"].alias("bearing"),
        F.coalesce(epoch_instant(v["timestamp"]), F.col("header_at")).alias("position_updated_at"),
        *[v["trip"][f].alias(f"vp_{f}") for f in MISMATCH_FIELDS],
    )
    return _last_per_trip(rows, ["cycle_at", "trip_id"])


def long_stop_time_updates(tu: DataFrame, keys: Sequence[str] = ("cycle_at", "trip_id")) -> DataFrame:
    return tu.select(*keys, F.posexplode("stop_time_updates").alias("pos", "_s")).select(*keys, "pos", "_s.*")


def merge_feeds(tu: DataFrame, vp: DataFrame, cycle: str = "cycle_at") -> DataFrame:
    """All trips of either feed per cycle; schedule fields come only from trip updates.

    Both sides hold one row per key, so the full join cannot fan out or skew.
    """
    t = tu.withColumn("in_tu", F.lit(True))
    v = vp.withColumn("in_vp", F.lit(True))
    joined = t.join(v, [cycle, "trip_id"], "full")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_tu", "in_vp")})


def has_schedule(at: str = "schedule_updated_at") -> Column:
    return F.col(at).isNotNull()


def has_position(at: str = "position_updated_at") -> Column:
    return F.col(at).isNotNull()


def discrepancies(
    merged: DataFrame, cycle: str = "cycle_at", fields: Sequence[str] = MISMATCH_FIELDS
) -> DataFrame:
    """Disagreements between the feeds: a vehicle without an update, or up to one row per differing field."""
    entry = lambda kind, tu, vp: F.struct(
        F.lit(kind).alias("discrepancy_type"), tu.cast("string").alias("tu_value"), vp.cast("string").alias("vp_value")
    )
    none = F.lit(None).cast("string")
    alone = entry(VP_WITHOUT_TU, none, F.col("vp_route_id"))
    pairs = [entry(f"{f}_mismatch", F.col(f), F.col(f"vp_{f}")) for f in fields]
    differing = F.filter(
        F.array(*pairs), lambda d: d["vp_value"].isNotNull() & ~F.equal_null(d["tu_value"], d["vp_value"])
    )
    found = F.when(~F.col("in_tu"), F.array(alone)).otherwise(differing)
    return merged.filter("in_vp").select(cycle, "trip_id", F.explode(found).alias("_d")).select(cycle, "trip_id", "_d.*")


def newly_raised(
    events: DataFrame, cycle_no: str, keys: Sequence[str] = ("trip_id", "discrepancy_type")
) -> DataFrame:
    """Keep a condition only in the first of consecutive cycles that report it."""
    scanned = ordered_scan(
        events, list(keys), [cycle_no], F.floor(F.col(cycle_no) / 360), lags={"_before": cycle_no},
    )
    fresh = F.col("_before").isNull() | (F.col(cycle_no) - F.col("_before") > 1)
    return scanned.filter(fresh).drop("_before")


def header_changes(
    polls: DataFrame, feed: str, at: str, header: str, *, tie: str | None = None, chunk_s: int = 3_600,
) -> DataFrame:
    """Flag polls whose header is missing or differs from the feed's previous poll (the first one counts).

    ``at`` is a number (seconds); ``interval`` is the step since the previous change.
    """
    order = [at] + ([tie] if tie else [])
    scanned = ordered_scan(
        polls, [feed], order, F.floor(F.col(at) / chunk_s), lags={"_seen": F.lit(True), "_before": header},
    )
    changed = F.col("_seen").isNull() | F.col(header).isNull() | ~F.equal_null("_before", header)
    # the previous poll still shows the header of the previous change
    step = F.when(changed, F.col(header) - F.col("_before"))
    return scanned.withColumns({"is_change": changed, "interval": step}).drop("_seen", "_before")


def reused_content(
    polls: DataFrame, feed: str, at: str, header: str, *, tie: str | None = None, chunk_s: int = 3_600,
) -> DataFrame:
    """Which poll's content stands for each poll: its own when the header changed, else that of the last change."""
    flagged = checkpointed(header_changes(polls, feed, at, header, tie=tie, chunk_s=chunk_s))
    return ordered_scan(
        flagged, [feed], [at] + ([tie] if tie else []), F.floor(F.col(at) / chunk_s),
        fills={"content_at": F.when(F.col("is_change"), F.col(at))},
    )


def delta_log(snapshots: DataFrame, cycle: str, key: str = "trip_id") -> DataFrame:
    """Changes between consecutive full snapshots: rows new or different, and keys gone, per cycle.

    ``cycle`` numbers the snapshots without holes.
    """
    fields = F.struct(*[c for c in snapshots.columns if c not in (cycle, key)])
    last = snapshots.agg(F.max(cycle).alias("_last"), F.lit(1).alias("_one"))
    scanned = ordered_scan(
        snapshots.withColumn("_value", fields), [key], [cycle], F.floor(F.col(cycle) / 360),
        lags={"_prev": cycle, "_before": "_value"}, leads={"_next": cycle},
    ).withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")
    same = (F.col("_prev") == F.col(cycle) - 1) & F.equal_null("_before", "_value")
    gone = (F.col(cycle) < F.col("_last")) & (F.col("_next").isNull() | (F.col("_next") > F.col(cycle) + 1))
    events = F.array_compact(F.array(
        F.when(~F.coalesce(same, F.lit(False)), F.struct(F.col(cycle).alias("c"), F.lit("changed").alias("change"))),
        F.when(gone, F.struct((F.col(cycle) + 1).alias("c"), F.lit("removed").alias("change"))),
    ))
    return scanned.select(key, F.explode(events).alias("_e")).select(F.col("_e.c").alias(cycle), key, "_e.change")


def consecutive_fixes(
    fixes: DataFrame, key: str, at: str, tie: str | None = None, *, chunk_s: float = 3600.0
) -> DataFrame:
    """Each fix with the trip's next fix, the gap in seconds and the distance in metres."""
    order = [at] + ([tie] if tie else [])
    scanned = ordered_scan(
        fixes, [key], order, F.floor(F.col(at) / chunk_s),
        leads={"next_at": at, "next_lat": "lat", "next_lon": "lon"},
    ).filter(F.col("next_at").isNotNull())
    return scanned.withColumns({
        "gap_s": F.col("next_at") - F.col(at),
        "distance_m": haversine_m(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")),
    })


def with_previous_cycle(snapshots: DataFrame, cycle: str = "cycle") -> tuple[DataFrame, DataFrame]:
    """(every snapshot under the number of the cycle after it, every snapshot but those of the first cycle)."""
    cycles = snapshots.select(cycle).distinct()
    steps = ordered_scan(cycles, [], [cycle], F.floor(F.col(cycle) / 360), leads={"_next": cycle}, lags={"_before": cycle})
    previous = snapshots.join(steps.filter("_next IS NOT NULL").select(cycle, "_next"), cycle).drop(cycle).withColumnRenamed("_next", cycle)
    current = snapshots.join(steps.filter("_before IS NOT NULL").select(cycle), cycle, "left_semi")
    return previous.select(*snapshots.columns), current


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str | Sequence[str] = "trip_id") -> tuple[DataFrame, DataFrame]:
    """(changed rows of ``current``, keys only in ``previous``); with a cycle in the key, of all cycles at once."""
    key = [key] if isinstance(key, str) else list(key)
    fields = [c for c in current.columns if c not in key]
    before = previous.select(*key, F.struct(*fields).alias("_before"), F.lit(True).alias("_was"))
    joined = current.join(before, key, "left")
    changed = joined.filter(F.col("_was").isNull() | ~F.equal_null(F.struct(*fields), F.col("_before")))
    return changed.select(*current.columns), previous.select(*key).join(current.select(*key), key, "left_anti")


def apply_delta(state: DataFrame, changed: DataFrame, removed: DataFrame, key: str | Sequence[str] = "trip_id") -> DataFrame:
    """Upsert the changed rows and drop the removed keys."""
    key = [key] if isinstance(key, str) else list(key)
    touched = changed.select(*key).unionByName(removed.select(*key))
    return state.join(touched, key, "left_anti").unionByName(changed)
