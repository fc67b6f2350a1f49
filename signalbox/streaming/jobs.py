"""Micro-batch jobs: event appends, change publishing, rollup refresh, weekly digests.

All of them are ``foreachBatch`` or plain batch jobs around the batch operators, so a
stream and a rerun over stored data give the same tables.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalbox.functions.gtfstime import ZONE, service_date_of
from signalbox.operators import rollups as ro
from signalbox.operators.feeds import MISMATCH_FIELDS, discrepancies, snapshot_diff
from signalbox.session import checkpointed
from signalbox.sources import store

# fixed values
REFRESH_SECONDS = 300
DIGEST_HOUR = 8
MARKERS = "job string, service_date date, marked_at timestamp"


def append_stream(events: DataFrame, base: str, table: str, at: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of events to its day partitions."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        store.append_events(batch, base, table, at)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def merged_cycles(polls: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Both feeds' fields of each trip per poll cycle, from captured polls of either feed (``captures.stream_captures``).

    The last entity of a trip in a cycle wins on each side. A cycle comes out when the watermark has passed it; one row per
    trip and open cycle is kept until then.
    """
    sides = {"_t": F.col("_e.trip_update.trip"), "_v": F.col("_e.vehicle.trip")}
    named = F.array_compact(F.array(*[F.when(trip["trip_id"].isNotNull(), F.struct(
        trip["trip_id"].alias("trip_id"), F.lit(side).alias("side"), F.struct(*[trip[f].alias(f) for f in MISMATCH_FIELDS]).alias("fields"),
        F.col("_e.vehicle.position.latitude").alias("lat"), F.col("_e.vehicle.position.longitude").alias("lon"),
    )) for side, trip in sides.items()]))
    rows = polls.select("fetched_at", F.posexplode("feed.entity").alias("_pos", "_e")).select(
        "fetched_at", "_pos", F.explode(named).alias("_r"))
    place = lambda side: F.when(F.col("_r.side") == side, F.struct("fetched_at", "_pos"))
    latest = rows.groupBy(F.window("fetched_at", width).alias("_w"), F.col("_r.trip_id").alias("trip_id")).agg(
        F.max_by("_r", place("_t")).alias("_t"), F.max_by("_r", place("_v")).alias("_v"))
    return latest.select(
        F.col("_w.start").alias("cycle_at"), "trip_id", *[F.col(f"_t.fields.{f}").alias(f) for f in MISMATCH_FIELDS],
        *[F.col(f"_v.fields.{f}").alias(f"vp_{f}") for f in MISMATCH_FIELDS], F.col("_v.lat").alias("lat"), F.col("_v.lon").alias("lon"),
        F.col("_t").isNotNull().alias("in_tu"), F.col("_v").isNotNull().alias("in_vp"))


def discrepancy_stream(polls: DataFrame, base: str, checkpoint: str, width: str = "10 seconds", **trigger) -> StreamingQuery:
    """From captured polls to stored events: merge each cycle, compare the feeds, append what differs to its day."""
    events = discrepancies(merged_cycles(polls, width)).withColumnRenamed("cycle_at", "observed_at")
    return append_stream(events, base, "discrepancy_events", "observed_at", checkpoint, **trigger)


def window_counts(events: DataFrame, at: str, label: str, width: str = "5 minutes") -> DataFrame:
    """Events per time window and label; closes with the watermark of the input."""
    return events.groupBy(F.window(at, width).alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), label, "n"
    )


# --- change publishing ---


def _latest_state(spark: SparkSession, base: str, schema) -> DataFrame:
    done = store.read_table(spark, f"{base}/_batches", "batch_id bigint")
    newest = done.agg(F.max("batch_id").alias("b")).first().b
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/state/batch={newest}")


def publish_changes(current: DataFrame, base: str, batch_id: int, key: str = "trip_id") -> tuple[DataFrame, DataFrame]:
    """Write what changed and what vanished against the last published state, then the new state.

    The batch marker is written last, so a batch that failed half way is simply redone.
    """
    spark = current.sparkSession
    current = checkpointed(current)
    changed, removed = snapshot_diff(_latest_state(spark, base, current.schema), current, key)
    changed.write.mode("overwrite").parquet(f"{base}/changed/batch={batch_id}")
    removed.write.mode("overwrite").parquet(f"{base}/removed/batch={batch_id}")
    current.write.mode("overwrite").parquet(f"{base}/state/batch={batch_id}")
    spark.range(batch_id, batch_id + 1).withColumnRenamed("id", "batch_id").write.mode("append").parquet(f"{base}/_batches")
    return changed, removed


def latest_per_trip(batch: DataFrame, order: str) -> DataFrame:
    rest = [c for c in batch.columns if c != "trip_id"]
    return batch.groupBy("trip_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("trip_id", "_r.*")


def change_stream(snapshots: DataFrame, base: str, checkpoint: str, order: str = "at_s", **trigger) -> StreamingQuery:
    """First the whole state, then only differences, one pair of tables per micro-batch.

    Every cycle is a full snapshot, so the newest cycle of a batch is the state to publish.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(order).alias(order))
        publish_changes(latest_per_trip(batch.join(newest, order, "left_semi"), order), base, batch_id)

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


# --- rollups ---


def _roll_up(spark: SparkSession, events_base: str, out: str, routes: DataFrame, days: list[date]) -> DataFrame:
    events, coverage = store.read_days(spark, events_base, "trip_completion_events", days)
    covered = coverage.filter("is_covered").select("service_date")
    usable = events.join(covered, "service_date", "left_semi").withColumn("actual_at", F.col("actual_terminus_arrival"))
    first = ro.first_completions(usable, ["recorded_at", "actual_terminus_arrival", "status"])
    for name, build in (
        ("line", ro.line_day_rollup), ("hour", ro.hour_day_rollup), ("histogram", ro.histogram_day_rollup)
    ):
        store.upsert_days(build(first, routes), store.table_path(out, name))
    return covered


def _marked(spark: SparkSession, out: str, job: str) -> date | None:
    markers = store.read_table(spark, store.table_path(out, "_markers"), MARKERS)
    return markers.filter(F.col("job") == job).agg(F.max("service_date").alias("d")).first().d


def _mark(spark: SparkSession, out: str, job: str, day: date) -> None:
    spark.range(1).select(F.lit(job).alias("job"), F.lit(day).alias("service_date"), F.current_timestamp().alias("marked_at")) \
        .write.mode("append").parquet(store.table_path(out, "_markers"))


def finalize_yesterday(spark: SparkSession, events_base: str, out: str, routes: DataFrame, now: datetime) -> bool:
    """Roll the elapsed day up once; a day that was never recorded stays open and is tried again."""
    yesterday = service_date_of(now) - timedelta(days=1)
    last = _marked(spark, out, "finalize")
    if last is not None and last >= yesterday:
        return False
    if not _roll_up(spark, events_base, out, routes, [yesterday]).limit(1).count():
        return False
    _mark(spark, out, "finalize", yesterday)
    return True


def refresh_today(spark: SparkSession, events_base: str, out: str, routes: DataFrame, now: datetime) -> None:
    """Roll the open day up again; meant to run every ``REFRESH_SECONDS``."""
    _roll_up(spark, events_base, out, routes, [service_date_of(now)])


def refresh_stream(
    events: DataFrame, events_base: str, out: str, routes: DataFrame, checkpoint: str, **trigger
) -> StreamingQuery:
    """Refresh the open day and finalize the elapsed one after each micro-batch of completions."""
    def run(batch: DataFrame, _batch_id: int) -> None:
        now = datetime.now(timezone.utc)
        finalize_yesterday(batch.sparkSession, events_base, out, routes, now)
        refresh_today(batch.sparkSession, events_base, out, routes, now)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": f"{REFRESH_SECONDS} seconds"})
    ).start()


# --- weekly digest ---


def last_boundary(now: datetime, hour: int = DIGEST_HOUR) -> date:
    """Local date of the latest Monday whose digest hour has passed."""
    local = now.astimezone(ZoneInfo(ZONE))
    monday = local.date() - timedelta(days=local.weekday())
    return monday - timedelta(days=7) if local.date() == monday and local.hour < hour else monday


def weekly_digest(spark: SparkSession, events_base: str, out: str, now: datetime, min_sample: int = ro.MIN_LINE_SAMPLE) -> bool:
    """Compute the digest of the seven days before the last Monday boundary, once per boundary."""
    boundary = last_boundary(now)
    if _marked(spark, out, "digest") == boundary:
        return False
    days = [boundary - timedelta(days=back) for back in range(7, 0, -1)]
    events, _coverage = store.read_days(spark, events_base, "trip_completion_events", days)
    store.append_digest(ro.weekly_network_stats(events), ro.weekly_line_stats(events, min_sample), out)
    _mark(spark, out, "digest", boundary)
    return True
