"""Live / coasting / ghost lifecycle over a stored capture, without a row per absent cycle.

``cycles``: ``at`` (epoch seconds) and ``backoff``.  ``touches``: one row per (trip_id,
at) that either feed mentions, with ``has_position``, ``lat``, ``lon``.  ``resolutions``:
``trip_id``, ``at``, ``reason``.

The clock of a missing train stands still while polling backs off.  With ``active_s`` the
running total of cycle steps outside backoff, a train last fixed at ``f`` has been
missing for ``active_s(c) - active_s(f)`` seconds at cycle ``c``; everything else follows
from comparing that number at a few interesting rows per trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.geo import loop_contained
from signalbox.operators.ordered import nearest_instant, ordered_scan
from signalbox.session import checkpointed

# fixed values
COASTING_TIMEOUT_S = 90
MAX_GHOST_AGE_S = 7_200
RESOLUTION_RETENTION_S = 21_600

EPISODE_COLUMNS = (
    "trip_id", "reason", "emitted_at", "last_seen_at", "last_seen_lat", "last_seen_lon", "reappeared_at",
    "reappear_lat", "reappear_lon", "ghost_started_at", "ghost_duration_s", "backoff_overlapped", "loop_contained",
)


def timeline(cycles: DataFrame, chunk_s: int = 86_400) -> DataFrame:
    """Cycles with the previous cycle, the running active seconds and the running backoff count.

    One row per poll cycle, so it is small against the captures; materialised because
    every later step looks times up in it.
    """
    chunk = F.floor(F.col("at") / chunk_s)
    stepped = checkpointed(ordered_scan(cycles.select("at", "backoff"), [], ["at"], chunk, lags={"prev_at": "at"}))
    step = F.when(F.col("backoff"), 0).otherwise(F.coalesce(F.col("at") - F.col("prev_at"), F.lit(0)))
    return checkpointed(
        ordered_scan(
            stepped, [], ["at"], chunk,
            sums={"active_s": step, "backoffs": F.col("backoff").cast("bigint")},
        ).withColumns({
            "prev_active_s": F.col("active_s") - step,
            "prev_backoffs": F.col("backoffs") - F.col("backoff").cast("bigint"),
        })
    )


def _first_reaching(rows: DataFrame, target: str, points: DataFrame, point: str, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the first point at or after the row's target; null when none."""
    found = nearest_instant(rows, target, points, point).select(target, F.col("next_point").alias("_p"))
    lookup = found.join(points.select(F.col(point).alias("_p"), F.col(value).alias(out)), "_p").select(target, out)
    return rows.join(lookup, target, "left")


def _interesting(
    touches: DataFrame, marks: DataFrame | None, line: DataFrame, coasting_s: float, max_age_s: float
) -> DataFrame:
    """Segment borders, possible reappearances and marks of each trip, with their last fix.

    A segment is a stretch in which the trip is never forgotten.  ``forget`` marks end one.
    """
    rows = touches.select(
        "trip_id", "at", "has_position", "lat", "lon", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("reason")
    )
    if marks is not None:
        rows = rows.unionByName(marks.select("trip_id", "at", "kind", "reason"), allowMissingColumns=True)
    clock = line.select("at", "prev_at", "active_s", "prev_active_s", "backoffs", "prev_backoffs")
    placed = rows.join(clock, "at")
    touch_at = F.when(F.col("kind") == 0, F.col("at"))
    fix = F.when(
        (F.col("kind") == 0) & F.col("has_position"), F.struct("at", "lat", "lon", "active_s", "backoffs")
    )
    scanned = ordered_scan(
        placed, ["trip_id"], ["at", "kind"], F.floor(F.col("at") / 3600),
        fills_before={
            "prev_touch": touch_at, "fix": fix, "forgotten_at": F.when(F.col("kind") == 2, F.col("at")),
        },
        fills_after={
            "next_touch": F.when(F.col("kind") == 0, F.struct("at", "prev_at")),
            "next_forget": F.when(F.col("kind") == 2, F.col("at")), "next_fix": F.when(fix.isNotNull(), F.col("at")),
        },
    )
    is_touch = F.col("kind") == 0
    aged = F.coalesce(F.col("prev_at") - F.col("prev_touch") >= max_age_s, F.lit(False))
    forgotten = F.coalesce(F.col("forgotten_at") >= F.col("prev_touch"), F.lit(False))
    starts = is_touch & (F.col("prev_touch").isNull() | aged | forgotten)
    next_aged = F.coalesce(F.col("next_touch.prev_at") - F.col("at") >= max_age_s, F.lit(False))
    next_forgotten = F.coalesce(
        (F.col("next_forget") >= F.col("at")) & (F.col("next_forget") < F.col("next_touch.at")), F.lit(False)
    )
    ends = is_touch & (F.col("next_touch").isNull() | next_aged | next_forgotten)
    missing = F.col("prev_active_s") - F.col("fix.active_s")
    maybe_back = is_touch & F.col("has_position") & ~starts & (
        F.col("fix").isNull() | (missing >= coasting_s) | (F.col("prev_at") - F.col("fix.at") >= max_age_s)
        | (F.col("fix.at") < F.col("forgotten_at"))
    )
    kept = scanned.withColumns({"starts": starts, "ends": ends, "maybe_back": maybe_back}).filter(
        F.col("starts") | F.col("ends") | F.col("maybe_back") | ~is_touch
    )
    # a few rows per trip run are left; the segment start is carried over these only
    kept = checkpointed(kept)
    seg = ordered_scan(
        kept, ["trip_id"], ["at", "kind"], F.floor(F.col("at") / 3600),
        fills={"segment_at": F.when(F.col("starts"), F.col("at"))},
    )
    return seg.withColumn("fix", F.when(F.col("fix.at") >= F.col("segment_at"), F.col("fix")))


def _episode(rows: DataFrame, reason: Column, at: Column, fix: str, start: Column, overlapped: Column, back: bool) -> DataFrame:
    seen = lambda f: F.col(f"{fix}.{f}")
    none = F.lit(None).cast("double")
    lat, lon = (F.col("lat"), F.col("lon")) if back else (none, none)
    return rows.select(
        "trip_id", reason.alias("reason"), at.alias("emitted_at"), seen("at").alias("last_seen_at"),
        seen("lat").alias("last_seen_lat"), seen("lon").alias("last_seen_lon"),
        (at if back else F.lit(None).cast("bigint")).alias("reappeared_at"),
        lat.alias("reappear_lat"), lon.alias("reappear_lon"), start.alias("ghost_started_at"),
        (at - start).cast("double").alias("ghost_duration_s"), F.coalesce(overlapped, F.lit(False)).alias("backoff_overlapped"),
        loop_contained(seen("lat"), seen("lon"), lat, lon).alias("loop_contained"),
    )


def _applied_resolutions(
    touches: DataFrame, resolutions: DataFrame, line: DataFrame, coasting_s, max_age_s, retention_s
) -> DataFrame:
    """Episodes closed by a known outcome, at once or at the next ghost transition."""
    marks = resolutions.select("trip_id", "at", "reason", F.lit(1).alias("kind"))
    rows = _interesting(touches, marks, line, coasting_s, max_age_s).filter("kind = 1")
    tracked = F.col("prev_touch").isNotNull() & (F.col("at") - F.col("prev_touch") < max_age_s)
    rows = rows.withColumns({
        "fix": F.when(tracked, F.col("fix")), "tracked": tracked,
        "ghost_target": F.when(tracked, F.col("fix.active_s") + coasting_s),
    })
    firsts = line.groupBy("active_s").agg(F.min("at").alias("at"))
    rows = _first_reaching(rows, "ghost_target", firsts, "active_s", "at", "ghost_at")
    ghost_now = F.col("tracked") & (F.col("fix").isNull() | (F.col("ghost_at") <= F.col("at")))
    # not a ghost yet: kept until the ghost transition, if that comes before a new fix and in time
    waits = F.col("tracked") & ~F.coalesce(ghost_now, F.lit(False)) & F.col("ghost_at").isNotNull() & (
        F.col("next_fix").isNull() | (F.col("ghost_at") < F.col("next_fix"))
    )
    # not tracked: kept until the trip turns up without a position
    turns_up = ~F.col("tracked") & F.col("next_touch").isNotNull() & (
        F.col("next_fix").isNull() | (F.col("next_touch.at") < F.col("next_fix"))
    )
    at = F.when(ghost_now, F.col("at")).when(waits, F.col("ghost_at")).when(turns_up, F.col("next_touch.at"))
    start = F.when(ghost_now, F.col("ghost_at"))
    ended = rows.withColumn("_at", at).filter(F.col("_at").isNotNull())
    clock = line.select(F.col("at").alias("_at"), F.col("backoffs").alias("_b"), F.col("prev_at").alias("_before"))
    overlapped = F.col("_b") - F.col("fix.backoffs") > 0
    # a stored outcome is dropped at the end of the first cycle that finds it too old
    ended = ended.join(clock, "_at").filter(ghost_now | (F.col("_before") - F.col("at") < retention_s))
    return _episode(ended, F.col("reason"), F.col("_at"), "fix", start, overlapped, back=False)


def ghost_episodes(
    touches: DataFrame,
    cycles: DataFrame,
    resolutions: DataFrame | None = None,
    *,
    coasting_s: float = COASTING_TIMEOUT_S,
    max_age_s: float = MAX_GHOST_AGE_S,
    retention_s: float = RESOLUTION_RETENTION_S,
    flush: bool = True,
) -> DataFrame:
    """Every closed ghost episode: reappeared, timed_out, resolved, and flushed at the end of the capture."""
    line = timeline(cycles)
    applied, forgets = None, None
    if resolutions is not None:
        applied = checkpointed(_applied_resolutions(
            touches, resolutions, line, coasting_s, max_age_s, retention_s
        ))
        forgets = applied.select("trip_id", F.col("emitted_at").alias("at"), F.lit(2).alias("kind"), "reason").distinct()
    rows = checkpointed(_interesting(touches, forgets, line, coasting_s, max_age_s).filter("kind = 0"))
    firsts = line.groupBy("active_s").agg(F.min("at").alias("at"))
    none = F.lit(None).cast("bigint")

    # a fix after a ghost stretch
    back = rows.filter(
        F.col("maybe_back") & (F.col("fix").isNull() | (F.col("prev_active_s") - F.col("fix.active_s") >= coasting_s))
    ).withColumn("_target", F.col("fix.active_s") + coasting_s)
    back = _first_reaching(back, "_target", firsts, "active_s", "at", "_ghost_at")
    episodes = _episode(
        back, F.lit("reappeared"), F.col("at"), "fix", F.coalesce("_ghost_at", none),
        F.col("prev_backoffs") - F.col("fix.backoffs") > 0, back=True,
    )

    # the end of a segment: forgotten after max_age_s, or still open when the capture stops
    own = F.when(F.col("has_position"), F.struct("at", "lat", "lon", "active_s", "backoffs")).otherwise(F.col("fix"))
    last = rows.filter("ends").withColumns({"_own": own, "_evict": F.col("at") + max_age_s})
    last = _first_reaching(last, "_evict", line, "at", "at", "_evicted_at").withColumn(
        "_evicted_at", F.when(F.col("next_touch").isNull() | (F.col("_evicted_at") < F.col("next_touch.at")), F.col("_evicted_at"))
    )
    final = line.agg(F.max("at").alias("_final_at"), F.lit(1).alias("_one"))
    last = last.withColumn("_one", F.lit(1)).join(F.broadcast(final), "_one").withColumn(
        "_close", F.coalesce("_evicted_at", "_final_at")
    ).filter(F.col("next_forget").isNull() | (F.col("next_forget") > F.col("_close")) | (
        F.col("next_touch").isNotNull() & (F.col("next_forget") >= F.col("next_touch.at"))
    ))
    clock = line.select(F.col("at").alias("_close"), F.col("active_s").alias("_a"), F.col("backoffs").alias("_b"))
    last = last.join(clock, "_close").filter(
        F.col("_own").isNull() | (F.col("_a") - F.col("_own.active_s") >= coasting_s)
    ).withColumn("_target", F.col("_own.active_s") + coasting_s)
    last = _first_reaching(last, "_target", firsts, "active_s", "at", "_ghost_at")
    if not flush:
        last = last.filter(F.col("_evicted_at").isNotNull())
    reason = F.when(F.col("_evicted_at").isNotNull(), "timed_out").otherwise("flushed")
    episodes = episodes.unionByName(_episode(
        last, reason, F.col("_close"), "_own", F.coalesce("_ghost_at", none), F.col("_b") - F.col("_own.backoffs") > 0,
        back=False,
    ))
    return episodes if applied is None else episodes.unionByName(applied)


def tracked_trips(
    touches: DataFrame, cycles: DataFrame, *, coasting_s: float = COASTING_TIMEOUT_S, max_age_s: float = MAX_GHOST_AGE_S,
) -> DataFrame:
    """State of every trip still tracked after the last cycle: status, last fix, last touch, ghost start."""
    line = timeline(cycles)
    rows = _interesting(touches, None, line, coasting_s, max_age_s).filter(
        F.col("ends") & F.col("next_touch").isNull()
    )
    own = F.when(F.col("has_position"), F.struct("at", "lat", "lon", "active_s", "backoffs")).otherwise(F.col("fix"))
    final = line.agg(
        F.max("at").alias("_now"), F.max_by("active_s", "at").alias("_a"), F.lit(1).alias("_one")
    )
    rows = rows.withColumns({"_own": own, "_one": F.lit(1)}).join(F.broadcast(final), "_one").filter(
        F.col("_now") - F.col("at") < max_age_s
    ).withColumn("_target", F.col("_own.active_s") + coasting_s)
    firsts = line.groupBy("active_s").agg(F.min("at").alias("at"))
    rows = _first_reaching(rows, "_target", firsts, "active_s", "at", "_ghost_at")
    status = (
        F.when(F.col("_own.at") == F.col("_now"), "live").when(F.col("_own").isNull(), "ghost")
        .when(F.col("_a") - F.col("_own.active_s") >= coasting_s, "ghost").otherwise("coasting")
    )
    return rows.select(
        "trip_id", status.alias("status"), F.col("_own.at").alias("last_seen_at"), F.col("_own.lat").alias("last_lat"),
        F.col("_own.lon").alias("last_lon"), F.col("at").alias("last_touched_at"),
        F.when(status == "ghost", F.col("_ghost_at")).alias("ghost_started_at"),
    )


def ghost_duration_so_far(now: Column) -> Column:
    return F.when(
        (F.col("status") == "ghost") & F.col("ghost_started_at").isNotNull(), (now - F.col("ghost_started_at")).cast("double")
    )


def is_current(now: Column, max_age_s: float = MAX_GHOST_AGE_S) -> Column:
    """Touched recently enough to be shown, or never touched."""
    return F.coalesce(now - F.col("last_touched_at") <= max_age_s, F.lit(True))


def status_counts(tracked: DataFrame) -> DataFrame:
    """Trips per status with all three statuses always present."""
    counts = tracked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    domain = tracked.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in ("live", "coasting", "ghost")])).alias("status"))
    return domain.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
