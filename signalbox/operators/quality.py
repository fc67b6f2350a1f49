"""Feed-quality measurements over stored captures.

Poll tables carry ``feed``, ``at`` (epoch seconds), ``header`` (epoch seconds) and so on;
fix tables carry ``trip_id``, ``at``, ``lat``, ``lon``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.geo import in_box
from signalbox.functions.gtfstime import gtfs_seconds, local_hour, local_time, time_band
from signalbox.operators.feeds import consecutive_fixes, header_changes
from signalbox.operators.ordered import exact_quantiles, nearest_instant, ordered_scan
from signalbox.schemas import RATE_LIMIT
from signalbox.session import checkpointed

# fixed values
AM_PEAK, PM_PEAK, DEGRADED_HOURS = (7, 9), (16, 18), (1, 4)
GHOST_THRESHOLDS_S = (60, 90)
BACKOFF_LADDER_S = (10, 30, 60, 300)
LOW_REMAINING = 5
STALE_AFTER_S = 300
VEHICLE_FIELDS = (
    "position.latitude", "position.longitude", "position.bearing", "position.speed", "stop_id", "current_status",
    "occupancy_status", "vehicle.id", "vehicle.label", "trip.trip_id", "trip.route_id", "trip.direction_id",
    "trip.schedule_relationship",
)


# --- polls ---


def capture_summary(polls: DataFrame, feed: str = "feed") -> DataFrame:
    """Per feed: window, hours, polls tried and won, and which local bands were seen."""
    hour = local_hour(F.timestamp_seconds("at"))
    seen = lambda band: F.coalesce(F.bool_or(F.col("ok") & (hour >= band[0]) & (hour < band[1])), F.lit(False))
    ok_at = F.when(F.col("ok"), F.col("at"))
    return polls.groupBy(feed).agg(
        F.min(ok_at).alias("window_start"), F.max(ok_at).alias("window_end"),
        ((F.max(ok_at) - F.min(ok_at)) / 3600.0).alias("hours_covered"),
        F.count(F.lit(1)).alias("polls_attempted"), F.count_if("ok").alias("polls_succeeded"),
        seen(AM_PEAK).alias("am_peak"), seen(PM_PEAK).alias("pm_peak"), seen(DEGRADED_HOURS).alias("overnight"),
    )


def error_counts(polls: DataFrame) -> DataFrame:
    return polls.filter(~F.col("ok")).groupBy("feed", F.coalesce("error", F.lit("unknown")).alias("error")).agg(
        F.count(F.lit(1)).alias("n")
    )


def field_population(vehicles: DataFrame, fields: Sequence[str] = VEHICLE_FIELDS) -> DataFrame:
    """Share of vehicle entities with a non-empty value, one row per field; one pass for all fields."""
    filled = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    counts = vehicles.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(filled(f)).alias(f"_c{i}") for i, f in enumerate(fields)]
    )
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_c{i}").alias("filled")) for i, f in enumerate(fields)])
    return counts.filter("_total > 0").select("_total", F.explode(rows).alias("_r")).select(
        F.col("_r.field").alias("field"), F.col("_total").alias("total_entities"), F.col("_r.filled").alias("filled"),
        (F.col("_r.filled") * 100.0 / F.col("_total")).alias("filled_pct"),
    )


def cadence(polls: DataFrame) -> DataFrame:
    """Per feed: header refresh intervals and data age, exact linear quantiles."""
    usable = polls.filter(F.col("header").isNotNull()).select("feed", "at", "header")
    changes = checkpointed(
        header_changes(usable, "feed", "at", "header").withColumn("age", F.col("at") - F.col("header"))
    )
    counts = changes.groupBy("feed").agg(
        F.count(F.lit(1)).alias("n_polls"), F.count_if("is_change").alias("n_header_changes"),
        F.min("interval").cast("double").alias("interval_min"), F.max("interval").cast("double").alias("interval_max"),
        F.max("age").cast("double").alias("age_max"),
    )
    intervals = exact_quantiles(
        changes, ["feed"], "interval", {"interval_p50": 0.5, "interval_p90": 0.9}, chunk_width=60,
    )
    ages = exact_quantiles(
        changes, ["feed"], "age", {"age_p50": 0.5, "age_p90": 0.9, "age_p99": 0.99}, chunk_width=1,
    )
    return counts.join(intervals, "feed", "left").join(ages, "feed", "left")


def zero_entity_overnight(polls: DataFrame, hours: tuple[int, int] = DEGRADED_HOURS) -> DataFrame:
    """Polls in the small hours, how many carried nothing, and whether their header still moved."""
    hour = local_hour(F.timestamp_seconds("at"))
    night = polls.filter((hour >= hours[0]) & (hour < hours[1]))
    empty = F.col("n_entities") == 0
    # more than one distinct header among the empty polls, without a distinct set
    head = F.when(empty, F.col("header"))
    sums = night.agg(
        F.count(F.lit(1)).alias("overnight_polls"), F.count_if(empty).alias("zero_entity_polls"),
        F.min(head).alias("_lo"), F.max(head).alias("_hi"),
    )
    zero = F.col("zero_entity_polls")
    return sums.filter("overnight_polls > 0").select(
        "overnight_polls", "zero_entity_polls", (zero * 100.0 / F.col("overnight_polls")).alias("zero_entity_pct"),
        F.when(zero >= 2, F.coalesce(F.col("_hi") > F.col("_lo"), F.lit(False))).alias("header_advances"),
    )


def parse_rate_limits(header: Column) -> Column:
    """Rate-limit header to an array of windows; malformed or missing is empty."""
    return F.coalesce(F.from_json(header, RATE_LIMIT, {"mode": "PERMISSIVE"}), F.array().cast(RATE_LIMIT))


def lowest_remaining(limits: Column) -> Column:
    return F.array_min(F.transform(limits, lambda w: w["remaining"]))


def lowest_remaining_per_cycle(polls: DataFrame, cycle: str, header: str) -> DataFrame:
    return polls.groupBy(cycle).agg(F.min(lowest_remaining(parse_rate_limits(F.col(header)))).alias("lowest_remaining"))


def feed_age(polls: DataFrame, now: Column, stale_after_s: int = STALE_AFTER_S, tie: str | None = None) -> DataFrame:
    """Per feed: last header change, its age at ``now`` and whether the feed is stale; ``tie`` orders polls of one second."""
    ties = [tie] if tie else []
    changed = header_changes(polls.select("feed", "at", "header", *ties), "feed", "at", "header", tie=tie)
    last = changed.groupBy("feed").agg(F.max(F.when(F.col("is_change"), F.col("at"))).alias("last_changed_at"))
    age = now - F.col("last_changed_at")
    return last.select(
        "feed", "last_changed_at", age.alias("age_s"), (F.coalesce(age > stale_after_s, F.lit(True))).alias("is_stale")
    )


def poll_outcomes(polls: DataFrame, window_s: int) -> DataFrame:
    """Cycles by outcome and lowest quota per time window."""
    start = (F.floor(F.col("at") / window_s) * window_s).cast("bigint")
    return polls.groupBy(start.alias("window_start")).agg(
        F.count_if("ok").alias("ok_polls"), F.count_if(~F.col("ok")).alias("failed_polls"),
        F.min("remaining").alias("lowest_remaining"),
    )


def outage_episodes(
    polls: DataFrame, keys: Sequence[str] = (), *, tie: str | None = None, low: int = LOW_REMAINING,
    ladder: Sequence[int] = BACKOFF_LADDER_S, chunk_s: int = 3_600,
) -> DataFrame:
    """Runs of bad cycles closed by the next good one.

    A cycle is bad when it failed or its quota is at most ``low``.  A run still open at
    the end of the data is not reported.  ``tie`` orders cycles of the same second.
    """
    order = ["at"] + ([tie] if tie else [])
    bad = ~F.col("ok") | F.coalesce(F.col("remaining") <= low, F.lit(False))
    flagged = polls.select(*keys, *order, "ok", bad.alias("is_bad"))
    scanned = ordered_scan(
        flagged, list(keys), order, F.floor(F.col("at") / chunk_s),
        fills_after={"ended_at": F.when(~F.col("is_bad"), F.col("at"))},
    )
    runs = scanned.filter(F.col("is_bad") & F.col("ended_at").isNotNull()).groupBy(*keys, "ended_at").agg(
        F.min("at").alias("started_at"), F.count(F.lit(1)).alias("bad_cycles"),
        F.count_if(~F.col("ok")).alias("consecutive_failures"),
    )
    steps = F.array(*[F.lit(float(s)) for s in ladder])
    level = F.element_at(steps, F.least(F.col("bad_cycles") + 1, F.lit(len(ladder))).cast("int"))
    return runs.select(
        *keys, "started_at", "ended_at", "bad_cycles", "consecutive_failures", level.alias("max_level_reached_s")
    )


# --- vehicle fixes ---


def valid_fixes(fixes: DataFrame) -> DataFrame:
    return fixes.dropna(subset=["trip_id", "lat", "lon"])


def loop_gap_share(gaps: DataFrame, thresholds: Sequence[int] = GHOST_THRESHOLDS_S) -> DataFrame:
    """Gaps at or over each threshold by which ends lie in the loop box."""
    first, last = in_box(F.col("lat"), F.col("lon")), in_box(F.col("next_lat"), F.col("next_lon"))
    classes = {"contained": first & last, "entry": ~first & last, "exit": first & ~last, "outside": ~first & ~last}
    counters = []
    for limit in thresholds:
        long = F.col("gap_s") >= limit
        counters.append(F.count_if(long).alias(f"total_{limit}"))
        counters += [F.count_if(long & cond).alias(f"{name}_{limit}") for name, cond in classes.items()]
    rows = F.array(*[
        F.struct(
            F.lit(int(limit)).alias("threshold_s"), F.col(f"total_{limit}").alias("total_gaps"),
            *[F.col(f"{name}_{limit}").alias(name) for name in classes],
        )
        for limit in thresholds
    ])
    pct = F.when(F.col("total_gaps") > 0, F.col("contained") * 100.0 / F.col("total_gaps"))
    return gaps.agg(*counters).select(F.explode(rows).alias("_r")).select("_r.*").withColumn("contained_pct", pct)


def freeze_runs(
    fixes: DataFrame, at: str = "at", tie: str | None = None, *, chunk_s: float = 3600.0
) -> DataFrame:
    """Runs of at least two consecutive in-box fixes with identical coordinates."""
    order = [at] + ([tie] if tie else [])
    chunk = F.floor(F.col(at) / chunk_s)
    inside = fixes.filter(in_box(F.col("lat"), F.col("lon"))).select("trip_id", *order, "lat", "lon")
    moved = checkpointed(
        ordered_scan(inside, ["trip_id"], order, chunk, lags={"_lat": "lat", "_lon": "lon"})
        .withColumn("_new", (~(F.equal_null("lat", "_lat") & F.equal_null("lon", "_lon"))).cast("int"))
    )
    runs = ordered_scan(moved, ["trip_id"], order, chunk, sums={"run": "_new"})
    return runs.groupBy("trip_id", "run").agg(
        F.count(F.lit(1)).alias("fixes"), F.min(at).alias("started_at"), F.max(at).alias("ended_at")
    ).filter("fixes >= 2").withColumn("duration_s", F.col("ended_at") - F.col("started_at"))


def city_loop_summary(
    fixes: DataFrame, at: str = "at", tie: str | None = None, *, min_gap_s: float = 30, min_jump_m: float = 300
) -> DataFrame:
    """Freeze, disappearance and teleport counts with exact medians, plus trips through the box."""
    gaps = consecutive_fixes(fixes, "trip_id", at, tie).filter(
        in_box(F.col("lat"), F.col("lon")) & (F.col("gap_s") > min_gap_s)
    )
    measures = (
        freeze_runs(fixes, at, tie).select(F.lit("freeze").alias("kind"), F.col("duration_s").cast("double").alias("v"))
        .unionByName(gaps.select(F.lit("disappearance").alias("kind"), F.col("gap_s").cast("double").alias("v")))
        .unionByName(
            gaps.filter(F.col("distance_m") > min_jump_m).select(F.lit("teleport").alias("kind"), F.col("distance_m").alias("v"))
        )
    )
    measures = checkpointed(measures)
    stats = measures.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max"))
    medians = exact_quantiles(measures, ["kind"], "v", {"p50": 0.5}, chunk_width=60)
    through = fixes.filter(in_box(F.col("lat"), F.col("lon"))).select("trip_id").distinct().agg(
        F.lit("trips_through").alias("kind"), F.count(F.lit(1)).alias("n")
    )
    return stats.join(medians, "kind", "left").unionByName(through, allowMissingColumns=True)


# --- coverage against the timetable ---

DAY_S = 86_400
LEVELS = 18  # block sizes of two to the power of 0 to 17, which holds two days of seconds


def trip_spans(stop_times: DataFrame) -> DataFrame:
    """First arrival and last departure per trip in elapsed seconds."""
    return stop_times.groupBy("trip_id").agg(
        F.min(gtfs_seconds("arrival_time")).alias("start_s"), F.max(gtfs_seconds("departure_time")).alias("end_s")
    )


def sample_grid(polls: DataFrame, at: str = "at", step_s: int = 300) -> DataFrame:
    """Evenly spaced instants from the first to the last poll."""
    ends = polls.agg(F.min(at).alias("a"), F.max(at).alias("b")).filter(F.col("a").isNotNull())
    return ends.select(F.explode(F.sequence("a", "b", F.lit(step_s).cast("bigint"))).alias("sample_at"))


def _looks(samples: DataFrame, active: DataFrame) -> DataFrame:
    """(sample_at, service_id, x): where to look a sample up among the spans of a service.

    A sample is looked up at its local second of the day on its own date, and a day later on the clock for the
    services of the previous date.
    """
    local = local_time(F.timestamp_seconds("sample_at"))
    second = (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).cast("bigint")
    looks = F.array(
        F.struct(F.to_date(local).alias("service_date"), second.alias("x")),
        F.struct(F.date_sub(F.to_date(local), 1).alias("service_date"), (second + DAY_S).alias("x")),
    )
    return samples.select("sample_at", F.explode(looks).alias("_l")).select("sample_at", "_l.*").join(
        active, "service_date"
    ).select("sample_at", "service_id", "x")


def _own_day(spans: DataFrame) -> DataFrame:
    """Spans cut at their day's end unless they start after it: the rest is not looked up under that date."""
    cut = F.when(F.col("start_s") < DAY_S, F.least("end_s", F.lit(DAY_S - 1))).otherwise(F.col("end_s"))
    return spans.filter(F.col("start_s") <= F.col("end_s")).withColumn("end_s", cut)


def _blocks(start: Column, end: Column) -> Column:
    """The fewest aligned power-of-two blocks that make up ``start..end``: two per size at most."""
    def of_size(level):
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first, stop = F.ceil(start / size), F.floor((end + 1) / size)
        odd = lambda c: c % 2 == 1
        after = first + F.when(odd(first), 1).otherwise(0)
        block = lambda n: F.struct(level.alias("level"), n.cast("bigint").alias("block"))
        return F.array(F.when((first < stop) & odd(first), block(first)), F.when((after < stop) & odd(stop), block(stop - 1)))

    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    return F.array_compact(F.flatten(F.transform(levels, of_size)))


def scheduled_running(samples: DataFrame, spans: DataFrame, trips: DataFrame, active: DataFrame) -> DataFrame:
    """Number and least id of the trips scheduled to be running at each sample that has any.

    Uses local wall-clock seconds. A span is laid down once, as power-of-two blocks of seconds, whatever number of
    samples and dates fall into it; per service and block only a count and the least id are kept. A sample
    adds up the one block of each size that holds its second, so no (sample, trip) pair is made.
    """
    laid = _own_day(spans).join(trips.select("trip_id", "service_id"), "trip_id").select(
        "service_id", "trip_id", F.explode(_blocks(F.col("start_s"), F.col("end_s"))).alias("_b")
    ).groupBy("service_id", "_b.level", "_b.block").agg(F.count(F.lit(1)).alias("_n"), F.min("trip_id").alias("_first"))
    looks = _looks(samples, active)
    # at most the seconds of two days per service, however many dates are looked at
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    asked = looks.select("service_id", "x").distinct().select("service_id", "x", levels).withColumn(
        "block", F.call_function("shiftright", F.col("x"), F.col("level")))
    found = asked.join(laid, ["service_id", "level", "block"]).groupBy("service_id", "x").agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    return looks.join(found, ["service_id", "x"]).groupBy("sample_at").agg(
        F.sum("_n").alias("scheduled"), F.min("_first").alias("first_trip"))


def nearest_poll(samples: DataFrame, polls: DataFrame, at: str = "at", tolerance_s: float = 60.0) -> DataFrame:
    """Nearest poll either side of each sample; the earlier wins a tie, none beyond the tolerance."""
    near = nearest_instant(samples, "sample_at", polls, at)
    back, ahead = F.col("sample_at") - F.col("prev_point"), F.col("next_point") - F.col("sample_at")
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("prev_point")).otherwise(F.col("next_point"))
    chosen = near.withColumn("poll_at", pick)
    return chosen.filter(F.abs(F.col("poll_at") - F.col("sample_at")) <= tolerance_s).select("sample_at", "poll_at")


def coverage_samples(
    samples: DataFrame, live: DataFrame, spans: DataFrame, trips: DataFrame, active: DataFrame, tolerance_s: float = 60.0
) -> DataFrame:
    """Percentage of scheduled trips seen live at each sample that has any scheduled trip and a poll nearby.

    ``live`` is (at, trip_id), at least one row per poll, trip_id null for an empty poll. The
    scheduled trips are counted, not listed; only live trips are looked up one by one.
    """
    nearest = nearest_poll(samples, live, tolerance_s=tolerance_s)
    seen = live.filter(F.col("trip_id").isNotNull()).select(F.col("at").alias("poll_at"), "trip_id").distinct()
    known = _own_day(spans).join(trips.select("trip_id", "service_id"), "trip_id")
    inside = (F.col("start_s") <= F.col("x")) & (F.col("x") <= F.col("end_s")) & ((F.col("x") >= DAY_S) == (F.col("start_s") >= DAY_S))
    # a live trip's own service decides on which of the sample's two dates it may run
    hits = seen.join(nearest, "poll_at").join(known, "trip_id").join(
        _looks(samples, active), ["sample_at", "service_id"]).filter(inside).groupBy("sample_at").agg(F.count(F.lit(1)).alias("live"))
    return (
        scheduled_running(samples, spans, trips, active).select("sample_at", "scheduled")
        .join(nearest.select("sample_at"), "sample_at").join(hits, "sample_at", "left")
        .withColumn("live", F.coalesce("live", F.lit(0).cast("bigint")))
        .withColumn("coverage_pct", F.col("live") * 100.0 / F.col("scheduled"))
        .withColumn("band", time_band(local_hour(F.timestamp_seconds("sample_at"))))
    )


def coverage_by_band(coverage: DataFrame) -> DataFrame:
    coverage = checkpointed(coverage)  # one row per sample
    stats = coverage.groupBy("band").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("coverage_pct").alias("mean_pct"), F.min("coverage_pct").alias("min_pct")
    )
    return stats.join(exact_quantiles(coverage, ["band"], "coverage_pct", {"p10_pct": 0.1}, chunk_width=1), "band", "left")


def poll_proximity(vp_polls: DataFrame, tu_polls: DataFrame, within_s: float = 15.0) -> DataFrame:
    """Share of distinct vehicle-poll times with an update poll close by."""
    usable = lambda df: df.filter(F.col("header").isNotNull()).select(F.col("at"))
    near = nearest_instant(usable(vp_polls), "at", usable(tu_polls), "at")
    gap = F.least(F.col("at") - F.col("prev_point"), F.col("next_point") - F.col("at"))
    counts = near.agg(
        F.count(F.lit(1)).alias("vp_polls"), F.count_if(gap <= within_s).alias("near_polls"),
        F.count(gap).alias("_any"),
    )
    return counts.filter("_any > 0").select(
        "vp_polls", "near_polls", (F.col("near_polls") * 100.0 / F.col("vp_polls")).alias("near_pct")
    )


# --- trip-id integrity ---


def join_rate(realtime: DataFrame, static: DataFrame) -> DataFrame:
    """Matched share of realtime trips, scheduled only and all; an empty set counts as 100."""
    flagged = realtime.join(
        static.select("trip_id").distinct().withColumn("_m", F.lit(True)), "trip_id", "left"
    ).withColumn("_m", F.coalesce("_m", F.lit(False)))
    scheduled = F.col("relationship") == "SCHEDULED"
    counts = flagged.agg(
        F.count_if(scheduled).alias("total_scheduled"), F.count_if(scheduled & F.col("_m")).alias("matched_scheduled"),
        F.count(F.lit(1)).alias("total_all"), F.count_if("_m").alias("matched_all"),
    )
    pct = lambda m, n: F.when(F.col(n) > 0, F.col(m) * 100.0 / F.col(n)).otherwise(F.lit(100.0))
    return counts.withColumns({
        "join_pct_scheduled_only": pct("matched_scheduled", "total_scheduled"),
        "join_pct_all": pct("matched_all", "total_all"),
    })


def unmatched_trips(realtime: DataFrame, static: DataFrame) -> DataFrame:
    return realtime.join(static.select("trip_id"), "trip_id", "left_anti")


def last_relationships(vp: DataFrame, tu: DataFrame, order: Sequence[str]) -> DataFrame:
    """Final schedule relationship per trip, updates ranking over vehicle positions."""
    side = lambda df, rank: df.select(
        "trip_id", F.coalesce("relationship", F.lit("SCHEDULED")).alias("relationship"), F.lit(rank).alias("_rank"), *order
    )
    both = side(vp, 0).unionByName(side(tu, 1)).filter(F.length("trip_id") > 0)
    return both.groupBy("trip_id").agg(F.max_by("relationship", F.struct("_rank", *order)).alias("relationship"))


def integrity_by_relationship(last: DataFrame, static: DataFrame) -> DataFrame:
    """Seen, matched and unmatched trips per relationship."""
    flagged = last.join(static.select("trip_id").distinct().withColumn("_m", F.lit(True)), "trip_id", "left")
    return flagged.groupBy("relationship").agg(
        F.count(F.lit(1)).alias("seen"), F.count("_m").alias("matched"),
        (F.count(F.lit(1)) - F.count("_m")).alias("unmatched"),
    )


# --- event counters ---


def event_counts(tables: Mapping[str, DataFrame], labels: Mapping[str, str]) -> DataFrame:
    """Rows per event table and label value (the table's counter label, or empty)."""
    parts = None
    for name, df in tables.items():
        label = F.col(labels[name]).cast("string") if name in labels else F.lit("")
        one = df.groupBy(F.lit(name).alias("event"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return event_counts(tables, {}).select(F.col("event").alias("table"), "n")


def discrepancy_ratio(discrepancies: DataFrame, polls: DataFrame, window_s: int) -> DataFrame:
    """Discrepancies per successful poll in each window that has one."""
    start = (F.floor(F.col("at") / window_s) * window_s).cast("bigint").alias("window_start")
    d = discrepancies.groupBy(start).agg(F.count(F.lit(1)).alias("discrepancies"))
    p = polls.filter("ok").groupBy(start).agg(F.count(F.lit(1)).alias("ok_polls"))
    return p.join(d, "window_start", "left").select(
        "window_start", "ok_polls", F.coalesce("discrepancies", F.lit(0)).alias("discrepancies"),
        (F.coalesce("discrepancies", F.lit(0)) / F.col("ok_polls")).alias("ratio"),
    )
