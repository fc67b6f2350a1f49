"""Where a train is against its stop updates: at a stop, between stops, or unknown.

All functions are column expressions over ``stop_time_updates`` (array in feed order,
epoch seconds as text) and an instant in epoch seconds; the geofence and nearby-train
operators are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.geo import degrees_for, grid_cell, haversine_m
from signalbox.operators.ordered import let

# fixed values
GEOFENCE_RADIUS_M = 100.0
NEARBY_RADIUS_M = 500.0


def anchors(updates: Column) -> Column:
    """Stops with at least one time, each side filled from the other, remembering which was real."""

    def anchor(s):
        arr, dep = s["arr_time"].try_cast("bigint"), s["dep_time"].try_cast("bigint")
        return F.struct(
            s["stop_id"].alias("stop_id"), s["stop_sequence"].cast("bigint").alias("stop_sequence"),
            F.coalesce(arr, dep).alias("arr"), F.coalesce(dep, arr).alias("dep"),
            arr.isNotNull().alias("had_arr"), dep.isNotNull().alias("had_dep"),
        )

    timed = F.filter(updates, lambda s: s["arr_time"].isNotNull() | s["dep_time"].isNotNull())
    return F.transform(timed, anchor)


def _first_pair(a: Column, now: Column) -> Column:
    """First adjacent pair that holds ``now``, in its dwell or in the gap after it."""
    rest = F.greatest(F.size(a) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(a, F.lit(1), rest), F.slice(a, F.lit(2), rest),
        lambda cur, nxt: F.struct(
            cur.alias("cur"), nxt.alias("nxt"), ((cur["arr"] <= now) & (now <= cur["dep"])).alias("dwell")
        ),
    )
    holds = lambda p: p["dwell"] | ((p["cur"]["dep"] <= now) & (now < p["nxt"]["arr"]))
    return F.get(F.filter(pairs, holds), 0)


def _state(status: str, at=None, origin=None, target=None, progress=None) -> Column:
    text = lambda c: (F.lit(None).cast("string") if c is None else c)
    return F.struct(
        F.lit(status).alias("status"), text(at).alias("at_stop_id"), text(origin).alias("from_stop_id"),
        text(target).alias("to_stop_id"),
        (F.lit(None).cast("double") if progress is None else progress.cast("double")).alias("progress"),
    )


def station_state(updates: Column, now: Column, last_dwell_is_at: bool = False) -> Column:
    """Struct of status, at/from/to stop and progress.

    A dwell at the last known stop that has a real departure comes out unknown unless
    ``last_dwell_is_at``; origin and terminus are told by the missing side of the feed.
    """

    def judge(a: Column, pair: Column) -> Column:
        head, tail = F.get(a, 0), F.element_at(a, -1)
        cur, nxt = pair["cur"], pair["nxt"]
        span = nxt["arr"] - cur["dep"]
        share = F.when(span <= 0, F.lit(0.0)).otherwise((now - cur["dep"]) / span)
        progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
        result = (
            F.when(F.size(a) <= 0, _state("unknown"))
            .when((now < head["arr"]) & ~head["had_arr"], _state("at", head["stop_id"]))
            .when(now < head["arr"], _state("between", target=head["stop_id"]))
            .when((now >= tail["dep"]) & ~tail["had_dep"], _state("at", tail["stop_id"]))
            .when(now >= tail["dep"], _state("between", origin=tail["stop_id"]))
            .when(pair["dwell"], _state("at", cur["stop_id"]))
            .when(pair.isNotNull(), _state("between", None, cur["stop_id"], nxt["stop_id"], progress))
        )
        if last_dwell_is_at:
            result = result.when((tail["arr"] <= now) & (now <= tail["dep"]), _state("at", tail["stop_id"]))
        return result.otherwise(_state("unknown"))

    known = let(anchors(updates), lambda a: let(_first_pair(a, now), lambda pair: judge(a, pair)))
    return F.when(updates.isNull(), _state("unknown")).otherwise(known)


def next_stop(updates: Column, now: Column) -> Column:
    """Struct of next stop id and its delay (arrival side first); null when not known yet."""

    def target(a: Column) -> Column:
        head, tail = F.get(a, 0), F.element_at(a, -1)
        ahead = F.when(now < head["arr"], head["stop_id"]).when(now < tail["dep"], _first_pair(a, now)["nxt"]["stop_id"])
        return F.when(F.size(a) > 0, ahead)

    def with_delay(stop: Column) -> Column:
        update = F.get(F.filter(updates, lambda s: s["stop_id"] == stop), 0)
        return let(update, lambda u: F.struct(
            stop.alias("next_stop_id"), F.coalesce(u["arr_delay"], u["dep_delay"]).alias("next_stop_delay")
        ))

    return let(let(anchors(updates), target), with_delay)


def progress_sequence(updates: Column, now: Column) -> Column:
    """Sequence of the stop most recently reached: one below the first known before it, the last after it."""

    def reached(a: Column) -> Column:
        head, tail = F.get(a, 0), F.element_at(a, -1)
        return F.when(
            F.size(a) > 0,
            F.when(now < head["arr"], head["stop_sequence"] - 1)
            .when(now >= tail["dep"], tail["stop_sequence"])
            .otherwise(_first_pair(a, now)["cur"]["stop_sequence"]),
        )

    return let(anchors(updates), reached)


def geofence(states: DataFrame, stops: DataFrame, radius_m: float = GEOFENCE_RADIUS_M) -> DataFrame:
    """Confirm a state by position: any implied stop within the radius; null without a position or state.

    ``states`` has a ``state`` struct and ``lat``/``lon``.  At most two stops are implied,
    so each is a plain lookup.
    """
    spots = stops.select("stop_id", F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))
    side = lambda n: spots.select(*[F.col(c).alias(f"{c}{n}") for c in spots.columns])
    joined = states.withColumns({
        "stop_id1": F.coalesce("state.at_stop_id", "state.from_stop_id"), "stop_id2": F.col("state.to_stop_id")
    }).join(side(1), "stop_id1", "left").join(side(2), "stop_id2", "left")
    near = lambda n: F.coalesce(
        haversine_m(F.col("lat"), F.col("lon"), F.col(f"_slat{n}"), F.col(f"_slon{n}")) <= radius_m, F.lit(False)
    )
    judged = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("state.status") != "unknown")
    return joined.withColumn("geofence_confirmed", F.when(judged, near(1) | near(2))).select(
        *states.columns, "geofence_confirmed"
    )


CELL_ROWS = 50_000


def nearby_trains(
    trains: DataFrame, stations: DataFrame, radius_m: float = NEARBY_RADIUS_M, hide_ghosts: bool = False
) -> DataFrame:
    """Positioned trains within the radius of each station.

    Trains are filed in grid cells, each station looks into its own and the eight
    surrounding cells, so distance is only checked for neighbours. A crowded cell is split further, into as many parts of about
    ``CELL_ROWS`` trains as it needs; the few stations around it are then looked up in each part. This also holds where all
    trains of a terminus report the very same position.
    """
    size = degrees_for(radius_m)
    seen = trains.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if hide_ghosts:
        seen = seen.filter(F.col("status") != "ghost")
    cx, cy = grid_cell(F.col("lat"), F.col("lon"), size)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = (
        stations.select("station_id", F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), cx.alias("_x"), cy.alias("_y"))
        .withColumn("_x", F.explode(F.transform(step, lambda d: F.col("_x") + d)))
        .withColumn("_y", F.explode(F.transform(step, lambda d: F.col("_y") + d)))
    )
    filed = seen.withColumns({"_x": cx, "_y": cy})
    crowded = filed.groupBy("_x", "_y").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    own = filed.join(crowded, ["_x", "_y"], "left").withColumn("_part", F.pmod(F.xxhash64(*trains.columns), parts)).drop("_parts")
    looked = around.join(crowded, ["_x", "_y"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    distance = haversine_m(F.col("_slat"), F.col("_slon"), F.col("lat"), F.col("lon"))
    return (
        own.join(looked, ["_x", "_y", "_part"])
        .withColumn("distance_m", distance).filter(F.col("distance_m") <= radius_m)
        .drop("_x", "_y", "_part", "_slat", "_slon")
    )
