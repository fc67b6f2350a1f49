"""Arrivals at stops and the headway between them, per (stop, route, direction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
MAX_ARRIVALS = 6
MIN_FOR_GAP = 3
GAP_FACTOR = 2
DWELL_RETENTION_S = 21_600
GROUP = ("stop_id", "route_id", "direction_id")


def arrivals(states: DataFrame, *, retention_s: float = DWELL_RETENTION_S, chunk_s: int = 3600) -> DataFrame:
    """First cycle of each dwell.

    ``states``: one row per (trip_id, at) with a schedule, with ``status``, ``at_stop_id``,
    ``route_id`` and ``direction_id``.  The very first cycle of the data only primes, and
    a trip of unknown direction is never recorded.

    A trip is cut into chunks of time. All rows but a chunk's first find the row before them inside it; the first one's
    is the last row of the chunk before, and only first and last rows meet per trip.
    """
    dwelling = F.when((F.col("status") == "at"), F.col("at_stop_id"))
    first = states.agg(F.min("at").alias("_first"), F.lit(1).alias("_one"))
    group = ["trip_id", "_chunk"]
    cut = states.select(
        "trip_id", "at", F.floor(F.col("at") / chunk_s).alias("_chunk"), dwelling.alias("_stop"), "route_id", "direction_id",
    ).repartition(*[F.col(c) for c in group])
    inside, here = Window.partitionBy(*group).orderBy("at"), F.struct("_stop", "at")
    placed = cut.withColumns({"_prev": F.lag(here).over(inside), "_last": F.lead(F.lit(True)).over(inside).isNull()})
    leads = F.col("_prev").isNull()
    edges = placed.filter(leads | F.col("_last")).withColumn(
        "_before", F.lag(here).over(Window.partitionBy("trip_id").orderBy("_chunk", ~leads)))
    rows = placed.filter(~leads).drop("_last").unionByName(
        edges.filter(leads).withColumn("_prev", F.col("_before")).drop("_last", "_before"))
    resumed = F.equal_null("_stop", "_prev._stop") & (F.col("at") - F.col("_prev.at") < retention_s)
    return (
        rows.filter(F.col("_stop").isNotNull() & ~F.coalesce(resumed, F.lit(False)) & F.col("direction_id").isNotNull())
        .withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").filter(F.col("at") > F.col("_first"))
        .select(F.col("_stop").alias("stop_id"), "route_id", "direction_id", "trip_id", F.col("at").alias("arrived_at"))
    )


def _info(n: Column, first: Column, last: Column, now: Column) -> list[Column]:
    average = F.when(n >= 2, (last - first) / (n - 1))
    waited = (now - last).cast("bigint")
    gap = (n >= MIN_FOR_GAP) & (average > 0) & (waited > GAP_FACTOR * average)
    return [
        average.alias("average_headway_seconds"), n.alias("sample_size"), waited.alias("seconds_since_last_arrival"),
        F.coalesce(gap, F.lit(False)).alias("gap_detected"),
    ]


def headways_at(arrived: DataFrame, now: Column) -> DataFrame:
    """Headway per group from its last arrivals up to ``now`` (epoch seconds).

    Only the newest few rows per group leave each map task, so a busy stop stays small.
    """
    newest = Window.partitionBy(*GROUP).orderBy(F.desc("arrived_at"), "trip_id")
    kept = arrived.filter(F.col("arrived_at") <= now).withColumn("_n", F.row_number().over(newest)).filter(
        F.col("_n") <= MAX_ARRIVALS
    )
    sums = kept.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("_n"), F.min("arrived_at").alias("_a"), F.max("arrived_at").alias("_b")
    )
    return sums.select(*GROUP, *_info(F.col("_n"), F.col("_a"), F.col("_b"), now))


def rolling_headways(arrived: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """Headway as it stood right after each arrival, over the last few arrivals of its group.

    A group is cut into chunks of time. Each chunk hands on its own last few arrivals, and as every chunk has one arrival at
    least, the few chunks before it hold all that a chunk's first rows need: no group is windowed as a whole.
    """
    back, group = MAX_ARRIVALS - 1, [*GROUP, "_chunk"]
    cut = arrived.withColumn("_chunk", F.floor(F.col("arrived_at") / chunk_s)).repartition(*[F.col(c) for c in group])
    inside = Window.partitionBy(*group).orderBy("arrived_at", "trip_id")
    placed = cut.withColumns({
        "_p": F.row_number().over(inside), "_n": F.count(F.lit(1)).over(Window.partitionBy(*group)),
        "_back": F.lag("arrived_at", back).over(inside), "_first": F.first("arrived_at").over(inside),
    })
    tails = placed.filter(F.col("_n") - F.col("_p") < back).groupBy(*group).agg(
        F.array_sort(F.collect_list("arrived_at")).alias("_tail"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*GROUP).orderBy("_chunk")
    recent = F.flatten(F.collect_list("_tail").over(before.rowsBetween(-back, -1)))  # a few of a few each
    carried = tails.select(
        *group, F.reverse(F.slice(F.reverse(recent), 1, back)).alias("_tail"),
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    joined = placed.drop("_n").join(carried, group)
    missing = F.size("_tail") - (MAX_ARRIVALS - F.col("_p"))  # place in the tail, which has fewer entries at the group's begin
    start = F.coalesce("_back", F.get("_tail", F.greatest(missing, F.lit(0))), "_first")
    size = F.least(F.coalesce("_before", F.lit(0)) + F.col("_p"), F.lit(MAX_ARRIVALS))
    return joined.select(
        *GROUP, "trip_id", "arrived_at",
        *_info(size, start, F.col("arrived_at"), F.col("arrived_at"))[:2],
    )
