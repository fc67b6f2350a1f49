"""Trip outcomes from stored trip updates: on time, late, cancelled or undetermined.

``rows``: one per (trip_id, at) with ``start_date``, ``route_id``, ``relationship`` and
``stop_time_updates``; ``termini``: trip_id, service_date, terminus_stop_id,
scheduled_arrival (see ``schedule.pinned_terminus``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.gtfstime import parse_start_date
from signalbox.functions.punctuality import ON_TIME_MAX_S, punctuality_status, terminus_delay
from signalbox.operators.ordered import greedy_chain, let, nearest_instant, ordered_scan
from signalbox.session import checkpointed

# fixed values
UNDETERMINED_TIMEOUT_S = 7_200
FINALIZED_RETENTION_S = 21_600


def terminus_update(updates: Column, stop_id: Column) -> Column:
    """First update of the stop, if it has an arrival and no departure (a genuine terminus)."""
    first = F.get(F.filter(updates, lambda s: s["stop_id"] == stop_id), 0)
    return let(first, lambda u: F.when(u["arr_time"].isNotNull() & u["dep_time"].isNull(), u))


def candidate_rows(rows: DataFrame, termini: DataFrame) -> DataFrame:
    """Readable rows with the trip's terminus for their own service date, where it has one."""
    dated = rows.withColumn("service_date", parse_start_date("start_date")).filter(F.col("service_date").isNotNull())
    static = termini.select("trip_id", "service_date", "terminus_stop_id", "scheduled_arrival")
    joined = dated.join(static, ["trip_id", "service_date"], "left")
    # a column of its own, so that the array is searched once per row
    joined = joined.withColumn("_u", terminus_update(F.col("stop_time_updates"), F.col("terminus_stop_id")))
    update = F.col("_u")
    actual = F.timestamp_seconds(update["arr_time"].try_cast("bigint"))
    delay = terminus_delay(update["arr_delay"], actual, F.col("scheduled_arrival"))
    cancelled = F.col("relationship") == "CANCELED"
    return joined.select(
        "trip_id", "at", "service_date", "route_id", F.col("terminus_stop_id").isNotNull().alias("has_terminus"),
        F.when(F.col("terminus_stop_id").isNotNull(), F.when(cancelled, "cancelled")
               .when(update.isNotNull(), punctuality_status(delay, ON_TIME_MAX_S))).alias("outcome"),
        F.when(~cancelled, actual).alias("actual_arrival"),
        F.when(~cancelled & update.isNotNull(), delay).alias("delay_seconds"),
    )


def trip_completions(
    rows: DataFrame,
    termini: DataFrame,
    cycles: DataFrame,
    *,
    timeout_s: float = UNDETERMINED_TIMEOUT_S,
    retention_s: float = FINALIZED_RETENTION_S,
    flush: bool = True,
) -> DataFrame:
    """One outcome per run of a trip.

    A run starts at a row with a known terminus and ends at its first cancelled or
    terminus row, else as undetermined at the first cycle after the trip has been missing
    for ``timeout_s`` (or at the end of the capture).  After an outcome the trip id is
    ignored for ``retention_s``.

    Rows are first reduced to stretches that end in the same outcome, wherever the run
    began in them; which stretches count is then a chain of choices over those few.
    """
    hour = F.floor(F.col("at") / 3600)
    line = ordered_scan(cycles.select("at"), [], ["at"], F.floor(F.col("at") / 86_400), lags={"prev_at": "at"})
    known = checkpointed(candidate_rows(rows, termini).join(line, "at"))
    cut = ordered_scan(known, ["trip_id"], ["at"], hour, lags={"_before": "at"}).withColumns({
        "_starts": F.when(F.col("_before").isNull() | (F.col("prev_at") - F.col("_before") >= timeout_s), F.col("at")),
        "_decides": F.col("outcome").isNotNull().cast("bigint"),
    })
    rows_in = checkpointed(ordered_scan(
        checkpointed(cut), ["trip_id"], ["at"], hour, fills={"run_at": "_starts"}, sums={"_decided": "_decides"},
    ).withColumn("part", F.col("_decided") - F.col("_decides")))
    stretch = ["trip_id", "run_at", "part"]

    registrable = F.when(F.col("has_terminus"), F.col("at"))
    parts = rows_in.groupBy(*stretch).agg(
        F.max(F.when(F.col("has_terminus"), F.coalesce("prev_at", F.col("at") - 1))).alias("can_start"),
        F.max("at").alias("last_at"),
        F.max(F.when(F.col("outcome").isNotNull(), F.col("at"))).alias("decided_at"),
        F.max(F.when(F.col("outcome").isNotNull(), F.struct("outcome", "actual_arrival", "delay_seconds"))).alias("_o"),
    ).filter(F.col("can_start").isNotNull()).withColumn("_target", F.col("last_at") + timeout_s)
    near = nearest_instant(parts, "_target", cycles, "at").select("_target", F.col("next_point").alias("_expired_at"))
    final = cycles.agg(F.max("at").alias("_final_at"), F.lit(1).alias("_one"))
    ended = checkpointed(
        parts.join(near, "_target", "left").withColumn("_one", F.lit(1)).join(F.broadcast(final), "_one").withColumns({
            "finalized_at": F.coalesce("decided_at", "_expired_at", "_final_at"),
            "is_open": F.col("decided_at").isNull() & F.col("_expired_at").isNull(),
        }).drop("_one", "_target", "_expired_at", "_final_at")
    )
    resume = F.col("finalized_at") + int(retention_s)
    chunk_s = max(int(timeout_s + retention_s), 86_400)
    counted = greedy_chain(ended, ["trip_id"], "can_start", resume, chunk_s=chunk_s)
    counted = ordered_scan(
        counted, ["trip_id"], ["can_start"], F.floor(F.col("can_start") / 86_400), lags={"blocked_until": resume},
    )
    free = rows_in.join(counted.select(*stretch, "blocked_until"), stretch).filter(
        F.col("blocked_until").isNull() | (F.col("prev_at") >= F.col("blocked_until"))
    )
    begun = free.groupBy(*stretch).agg(
        F.min(registrable).alias("registered_at"), F.min_by("service_date", registrable).alias("service_date")
    )
    # the route is the latest one named between start and outcome
    routes = free.join(begun.select(*stretch, "registered_at"), stretch).filter(
        F.col("at") >= F.col("registered_at")
    ).groupBy(*stretch).agg(F.max_by("route_id", F.when(F.col("route_id").isNotNull(), F.col("at"))).alias("route_id"))
    done = counted.join(begun, stretch).join(routes, stretch, "left")
    if not flush:
        done = done.filter(~F.col("is_open"))
    return done.select(
        "trip_id", "route_id", "service_date", "finalized_at",
        F.coalesce("_o.outcome", F.lit("undetermined_gap")).alias("status"),
        F.col("_o.actual_arrival").alias("actual_at"), F.col("_o.delay_seconds").alias("delay_seconds"),
    )


def resolutions_of(completions: DataFrame) -> DataFrame:
    """Outcomes that explain a disappearance; an undetermined gap does not."""
    return completions.filter(F.col("status") != "undetermined_gap").select(
        "trip_id", F.col("finalized_at").alias("at"),
        F.when(F.col("status") == "cancelled", "cancelled").otherwise("completed").alias("reason"),
    )
