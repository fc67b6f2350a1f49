"""Structured Streaming runs over the event table, and the jobs around them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import punctuality as pu
from signalbox.functions.gtfstime import service_date
from signalbox.operators import completion as co
from signalbox.operators import feeds as fd
from signalbox.operators import model as md
from signalbox.operators import rollups as ro
from signalbox.operators import schedule as sc
from signalbox.plans.archive_queries import _LOCAL_DAY, _STORED, _completion_events, _text
from signalbox.plans.canonical import Tables
from signalbox.plans.feed_queries import _TU_ENTITIES, merged
from signalbox.plans.registry import query
from signalbox.plans.schedule_queries import NEXT_DAY, _active, _today
from signalbox.plans.state_queries import (
    _ARRIVALS,
    _LINE,
    COAST,
    CYCLE_S,
    EVICT,
    KEEP,
    TRIP_KEPT_S,
    TRIP_LOST_S,
    _cycles,
    _dwell_states,
    _outcomes,
    _resolved_sql,
    _streamed_completion_sql,
    _termini,
    _touches,
    _update_rows,
)
from signalbox.schemas import EVENT_TABLES
from signalbox.session import scratch_path
from signalbox.sources import captures, store
from signalbox.streaming import jobs, trips

NOW = datetime(2024, 1, 16, 2, 0, tzinfo=timezone.utc)  # 13:00 local on a Tuesday


SLICES, SLICE_ROWS = 3, 5_000_000  # at least so many slices, at most about so many rows in one
SHARD_ROWS, SHARDS = 50_000, 16  # rows of a table for one shard of keys; at least so many shards
SPARSE_S = 21_600  # rows of a key are hours apart in these tables, so its buckets are wider
END_DAYS = 30  # beyond every time-out and retention of the queries


def _kept(t: Tables, table: DataFrame) -> DataFrame:
    """The table written once and read back, so that its plan does not run again for each look at it."""
    path = scratch_path(t.spark, "kept")
    table.write.parquet(path)
    return t.spark.read.schema(table.schema).parquet(path)


def _played(t: Tables, table: DataFrame, kinds: str, build, ended: bool = True, delay: str = "30 minutes"):
    """Run a stream over a whole table and read what it wrote.

    The table (with the instant ``ev``) arrives slice of time by slice of time, as many as its size asks for, and the stream is
    resumed from its checkpoint after each. Then a marker row of each ``kinds``, far later than the table,
    moves the watermark past every row of it. Filters may be pushed below the watermark, hence one of each
    kind; the watermark stays below the markers themselves, so they wait in state and are never part of an answer.
    """
    spark = trips.use_state_store(t.spark)
    staged, arriving, path, done = (scratch_path(spark, name) for name in ("staged", "arriving", "stream", "stream-checkpoint"))
    at = F.unix_micros("ev")
    n = table.count()
    slices, shards = max(SLICES, -(-n // SLICE_ROWS)), max(SHARDS, -(-n // SHARD_ROWS))
    cuts = table.select(at.alias("at")).stat.approxQuantile("at", [i / slices for i in range(1, slices)], 0.01 / slices)
    cut = sum((F.when(at > int(c), 1).otherwise(0) for c in cuts), F.lit(0))
    table.withColumn("_slice", cut).write.partitionBy("_slice").parquet(staged)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = folder(arriving).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder(arriving))
    arrives = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(arriving).withWatermark("ev", delay)
    out = build(arrives, shards)

    def run():
        dealt = spark.conf.get("spark.sql.shuffle.partitions")
        # a task of a stateful operator takes part of a second whatever its rows, and holds one shard at a time, so one per core does
        spark.conf.set("spark.sql.shuffle.partitions", min(int(dealt), max(SHARDS, spark.sparkContext.defaultParallelism)))
        try:
            running = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", done).trigger(
                availableNow=True).start(path)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", dealt)
        running.awaitTermination()

    for i in range(slices):
        ready = folder(f"{staged}/_slice={i}")
        if files.exists(ready) and not files.rename(ready, folder(f"{arriving}/{i}")):  # the files of a slice as they are, at once
            raise OSError(f"slice {i} could not be moved to {arriving}")
        run()
    if ended:
        end = F.lit(table.agg(F.max("ev")).first()[0]).cast("timestamp") + F.expr(f"interval {END_DAYS} days")
        for row in table.select(kinds).distinct().collect():  # a handful
            marker = table.filter(F.col(kinds).eqNullSafe(F.lit(row[0]))).limit(1)
            marker.withColumns({"ev": end, "at_s": F.unix_seconds(end)}).select(table.columns).write.mode("append").parquet(arriving)
        run()
    return spark.read.schema(out.schema).parquet(path)


def _stream(t: Tables, build, ended: bool = True):
    """Run a stream over the whole event table."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    ev = F.col("ts").cast("timestamp")
    rows = t.raw("events").select(
        "event_id", "event_type", "user_id", k.alias("k"), F.floor(F.unix_micros(ev) / 1_000_000).cast("bigint").alias("at_s"), ev.alias("ev"),
    )
    return _played(t, rows, "event_type", build, ended)


_FEED = """case event_id % 3 when 0 then 'vehicle_positions' when 1 then 'trip_updates' else 'service_alerts' end"""
_CONTENT = f"""
select feed, s as at_s, header, max(case when is_change then s end) over (partition by feed order by s, event_id
  rows between unbounded preceding and current row) as content_s, is_change
from (select *, row_number() over w = 1 or header is distinct from lag(header) over w as is_change from
 (select event_id, {_FEED} as feed, ts_us // 1000000 as s, ts_us // 3600000000 * 3600 as header from v_events)
 window w as (partition by feed order by s, event_id))"""


def _feed():
    return F.when(F.col("event_id") % 3 == 0, "vehicle_positions").when(F.col("event_id") % 3 == 1, "trip_updates").otherwise(
        "service_alerts")


@query("str01_header_content_stream", _CONTENT)
def _(t):
    header = (F.floor(F.col("at_s") / 3600) * 3600).cast("bigint")
    return _stream(t, lambda rows, shards: trips.header_changes(rows.select(_feed().alias("feed"), "at_s", header.alias("header"), "ev"), SPARSE_S, shards))


@query("str01_header_content_batch", _CONTENT)
def _(t):
    second = F.floor(F.col("ts_us") / 1_000_000).cast("bigint")
    polls = t.polls.select("poll_id", "feed", second.alias("at_s"), F.col("header_ts").alias("header"))
    return fd.reused_content(polls, "feed", "at_s", "header", tie="poll_id").select(
        "feed", "at_s", "header", F.col("content_at").alias("content_s"), "is_change")


@query("str08_paced_stream", """
with s as (select user_id, list(distinct ts_us // 1000000 order by ts_us // 1000000) as l from v_events
  where event_type in ('purchase', 'signup') group by user_id)
select cast(user_id as varchar) as trip_id, unnest(list_reduce(l, lambda acc, x: case when x >= acc[1] + 43200
 then list_prepend(x, acc) else acc end, [-1000000000])[:-2]) as at_s from s""")
def _(t):
    wanted = F.col("event_type").isin("purchase", "signup")
    return _stream(t, lambda rows, shards: trips.paced(
        rows.filter(wanted).select(F.col("user_id").cast("string").alias("trip_id"), "at_s", "ev"), 43_200, SPARSE_S, shards))


@query("str10_edge_trigger_stream", """
select trip_id, discrepancy_type, cycle from (select *, lag(cycle) over (partition by trip_id, discrepancy_type order by cycle) as p
 from (select distinct cast(user_id as varchar) as trip_id, event_type as discrepancy_type, ts_us // 21600000000 as cycle from v_events))
where p is null or cycle - p > 1""")
def _(t):
    cycle = F.floor(F.col("at_s") / 21_600).cast("bigint")
    return _stream(t, lambda rows, shards: trips.newly_raised(rows.select(
        F.col("user_id").cast("string").alias("trip_id"), F.col("event_type").alias("discrepancy_type"), cycle.alias("cycle"), "at_s", "ev"), keep_s=2 * 21_600, bucket_s=SPARSE_S, shards=shards))


@query("str09_dwell_stream", """
select trip_id, stop_id, direction_id, at_s from (select *, lag(st) over w as p, lag(at_s) over w as pa from (
 select event_id, cast(user_id as varchar) as trip_id, ts_us // 1000000 as at_s, case when event_type = 'view' then 'S'||(k % 3) end as st,
  'S'||(k % 3) as stop_id, cast(user_id % 2 as integer) as direction_id from v_events where event_type in ('view', 'click'))
 window w as (partition by trip_id order by at_s, event_id)) where st is not null
 and not coalesce(st = p and at_s - pa < 172800, false) and at_s > (select min(ts_us // 1000000) from v_events)""")
def _(t):
    states = lambda rows: rows.filter(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").cast("string").alias("trip_id"), "at_s", "ev",
        F.when(F.col("event_type") == "view", "at").otherwise("between").alias("status"),
        F.concat(F.lit("S"), (F.col("k") % 3).cast("string")).alias("at_stop_id"), F.lit("R").alias("route_id"),
        (F.col("user_id") % 2).cast("int").alias("direction_id"))
    first = t.polls.agg(F.floor(F.min("ts_us") / 1_000_000).alias("s")).first().s
    return _stream(t, lambda rows, shards: trips.arrivals(states(rows), first, 172_800, SPARSE_S, shards)).select(
        "trip_id", "stop_id", "direction_id", "at_s")


@query("str06_completion_stream", _streamed_completion_sql())
def _(t):
    """Trip updates against the trips' own termini; a gap ends at its time-out."""
    known = co.candidate_rows(_update_rows(t), _termini(t)).select(
        "trip_id", F.col("at").alias("at_s"), F.timestamp_seconds("at").alias("ev"), "has_terminus", F.col("service_date").cast("string").alias("service_date"),
        "route_id", "outcome", F.unix_seconds("actual_arrival").alias("actual_s"), F.col("delay_seconds").cast("bigint").alias("delay_seconds"))
    found = _played(t, known, "has_terminus", lambda rows, shards: trips.completions(
        rows, timeout_s=TRIP_LOST_S, retention_s=TRIP_KEPT_S, bucket_s=SPARSE_S, shards=shards))
    return found.select("trip_id", "route_id", "service_date", "finalized_s", "status", "delay_seconds")


@query("str09_headway_stream", f"""
{_ARRIVALS}, n as (select *, row_number() over w as rn, lag(arrived_at, 5) over w as six, first_value(arrived_at) over w as f from ar
  window w as (partition by stop_id, route_id, direction_id order by arrived_at, trip_id))
select stop_id, route_id, direction_id, trip_id, arrived_at as at_s, cast(least(rn, 6) as integer) as sample_size,
 case when rn > 1 then round((arrived_at - coalesce(six, f))::double / (least(rn, 6) - 1), 6) end as average_headway_seconds from n""")
def _(t):
    """Dwells per trip, then the last arrivals per stop, route and direction: two stateful operators in one stream."""
    states = _kept(t, _dwell_states(t).withColumnRenamed("at", "at_s").withColumn("ev", F.timestamp_seconds("at_s")))
    first = states.agg(F.min("at_s").alias("s")).first().s
    found = _played(t, states, "status", lambda rows, shards: trips.rolling_headways(
        trips.arrivals(rows, first, bucket_s=SPARSE_S, shards=shards), bucket_s=SPARSE_S, shards=shards))
    return found.withColumn("average_headway_seconds", F.round("average_headway_seconds", 6))


@query("snk01_discrepancy_event_stream", f"""
with t as (select *, ts_us // 21600000000 as cycle from ({_TU_ENTITIES})
  qualify row_number() over (partition by cycle, trip_id order by ts_us desc, pos desc) = 1),
 v as (select ts_us // 21600000000 as cycle, cast(user_id as varchar) as trip_id,
   case when k % 10 <> 0 then 'R'||(user_id % 20)||':' end as vr from v_events where event_type in ('view', 'click')
  qualify row_number() over (partition by ts_us // 21600000000, user_id order by ts_us desc) = 1),
 j as (select v.*, t.route_id, t.trip_id is not null as paired from v left join t on t.cycle = v.cycle and t.trip_id = v.trip_id)
select cycle * 21600 as observed_s, trip_id, 'vp_without_tu' as discrepancy_type, null::varchar as tu_value, vr as vp_value from j where not paired
union all select cycle * 21600, trip_id, 'route_id_mismatch', route_id, vr from j where paired and vr <> route_id
union all select cycle * 21600, trip_id, 'start_time_mismatch', '08:00:00', '' from j where paired""")
def _(t):
    """Captured polls of both feeds as files that arrive half by half; merged, compared, and appended to their days."""
    spark, (path, base, done) = t.spark, (scratch_path(t.spark, n) for n in ("captures", "history", "capture-checkpoint"))
    polls = t.update_captures.unionByName(t.vehicle_captures)
    ends = t.polls.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    instant = lambda us: datetime.fromtimestamp(us / 1_000_000, timezone.utc)
    cuts = [ends.a, (ends.a + ends.b) // 2, ends.b + 1_000_000]
    for start, end in zip(cuts, cuts[1:]):
        captures.time_slice(polls, instant(start), instant(end)).write.mode("append").json(path)
        jobs.discrepancy_stream(captures.stream_captures(spark, path), base, done, f"{CYCLE_S} seconds").awaitTermination()
    late = F.date_format(F.lit(instant(ends.b)) + F.expr(f"interval {END_DAYS} days"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    # a poll with entities: one without would be filtered below the watermark
    polls.limit(1).withColumn("fetch_timestamp", late).write.mode("append").json(path)
    jobs.discrepancy_stream(captures.stream_captures(spark, path), base, done, f"{CYCLE_S} seconds").awaitTermination()
    found = store.read_table(spark, store.table_path(base, "discrepancy_events"), f"{EVENT_TABLES['discrepancy_events']}, service_date date")
    return found.select(F.unix_seconds("observed_at").alias("observed_s"), "trip_id", "discrepancy_type", "tu_value", "vp_value")


def _lifecycle_rows(t: Tables, outcomes=None):
    """Cycles, touches and known outcomes of the whole table as one stream's rows."""
    rows = _cycles(t).select("at", F.lit(trips.CYCLE).alias("kind"), "backoff").unionByName(
        _touches(t).withColumn("kind", F.lit(trips.TOUCH)), allowMissingColumns=True)
    if outcomes is not None:
        rows = rows.unionByName(outcomes.select("trip_id", "at", "reason", F.lit(trips.OUTCOME).alias("kind")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    return rows.withColumns({"at_s": F.col("at"), "ev": F.timestamp_seconds("at")}).drop("at")


def _ghost_stream(t: Tables, outcomes=None):
    """Polls of a cycle are hours apart here, so buckets hold a day."""
    build = lambda rows, shards: trips.ghost_episodes(
        rows, coasting_s=COAST, max_age_s=EVICT, retention_s=KEEP, shards=shards, bucket_s=86_400)
    return _played(t, _lifecycle_rows(t, outcomes), "kind", build)


@query("str02_ghost_stream", f"""
{_LINE} select trip_id, reason, emitted_at as emitted_s, last_seen_at as last_seen_s, ghost_started_at as ghost_started_s,
 cast(emitted_at - ghost_started_at as double) as ghost_duration_s, backoff_overlapped from ep where reason <> 'flushed'""")
def _(t):
    return _ghost_stream(t).select(
        "trip_id", "reason", "emitted_s", "last_seen_s", "ghost_started_s", "ghost_duration_s", "backoff_overlapped")


@query("str05_resolved_stream", f"""
{_resolved_sql()} select trip_id, reason, emitted_at as emitted_s, last_seen_at as last_seen_s, ghost_started_at as ghost_started_s,
 cast(emitted_at - ghost_started_at as double) as ghost_duration_s, backoff_overlapped from ep where reason <> 'flushed'""")
def _(t):
    return _ghost_stream(t, _outcomes(t)).select(
        "trip_id", "reason", "emitted_s", "last_seen_s", "ghost_started_s", "ghost_duration_s", "backoff_overlapped")


@query("agg28_windowed_counter_stream", """
select ts_us // 3600000000 * 3600 as window_start_s, event_type, count(*) as n from v_events
where ts_us // 3600000000 * 3600 + 3600 <= (select max(ts_us) // 1000000 - 1800 from v_events) group by all""")
def _(t):
    counted = _stream(t, lambda rows, _: jobs.window_counts(rows, "ev", "event_type", "1 hour"), ended=False)
    return counted.select(F.unix_timestamp("window_start").alias("window_start_s"), "event_type", "n")


@query("str12_delta_log", """
with s as (select cycle, trip_id, route_id, delay, round(lat, 6) as lat from v_merged),
 x as (select *, lag(cycle) over w as p, lead(cycle) over w as nx, lag(route_id) over w as r0, lag(delay) over w as d0,
  lag(lat) over w as l0 from s window w as (partition by trip_id order by cycle))
select cycle, trip_id, 'changed' as change from x where p is distinct from cycle - 1 or r0 is distinct from route_id
 or d0 is distinct from delay or l0 is distinct from lat
union all select cycle + 1, trip_id, 'removed' from x where nx is distinct from cycle + 1 and cycle < (select max(cycle) from s)""")
def _(t):
    return fd.delta_log(merged(t).select("cycle", "trip_id", "route_id", "delay", F.round("lat", 6).alias("lat")), "cycle")


def _history(t: Tables):
    """Completion events of the whole month in a day-partitioned store."""
    base = scratch_path(t.spark, "history")
    events = _completion_events(t)
    store.append_events(events, base, "trip_completion_events", "observed_at",
                        recorded_at=F.timestamp_micros(F.unix_micros("observed_at")))
    days = events.select(service_date("observed_at").alias("service_date")).distinct()
    store.register_days(t.spark, base, days.select(
        "service_date", F.lit("trip_completion_events").alias("table"), F.lit("d").alias("digest")))
    return base


@query("str13_refresh_and_finalize", f"""
with f as (select * from ({_STORED}) qualify row_number() over (partition by d, trip_id order by ts_us) = 1)
select strftime(d, '%Y-%m-%d') as service_date, route_id, count(*) filter (status = 'on_time') as on_time_count,
 count(*) filter (status = 'late') as late_count, count(*) filter (status = 'cancelled') as cancelled_count,
 count(*) filter (status = 'undetermined_gap') as gap_count
from f where route_id is not null and d between DATE '2024-01-15' and DATE '2024-01-16' group by all""")
def _(t):
    base, out = _history(t), scratch_path(t.spark, "insights")
    jobs.finalize_yesterday(t.spark, base, out, t.routes, NOW)
    jobs.finalize_yesterday(t.spark, base, out, t.routes, NOW)  # the second call finds it done
    jobs.refresh_today(t.spark, base, out, t.routes, NOW)
    jobs.refresh_today(t.spark, base, out, t.routes, NOW)
    return t.spark.read.parquet(store.table_path(out, "line")).select(_text("service_date"), "route_id", *ro.LINE_COUNTS[:4])


@query("str14_weekly_digest", f"""
select '2024-01-08' as week_start, count(distinct d) as days_covered, count(*) filter (status = 'on_time') as on_time_count,
 count(*) filter (status = 'late') as late_count, count(*) filter (status = 'cancelled') as cancelled_count
from ({_STORED}) where d between DATE '2024-01-08' and DATE '2024-01-14'""")
def _(t):
    base, out = _history(t), scratch_path(t.spark, "digests")
    jobs.weekly_digest(t.spark, base, out, NOW)
    jobs.weekly_digest(t.spark, base, out, NOW)
    return t.spark.read.parquet(store.table_path(out, "weekly_digests")).select(
        _text("week_start"), "days_covered", *ro.LINE_COUNTS[:3])


@query("set05_trip_id_sets", """
with o as (select trip_id from v_trips_today), n as (select trip_id from v_trips where service_id in
  (select service_id from v_service_days where service_date = DATE '1998-06-16'))
select 'kept' as part, trip_id from o where trip_id in (select trip_id from n) union all
select 'dropped', trip_id from o where trip_id not in (select trip_id from n)""")
def _(t):
    old, new = _today(t).select("trip_id"), sc.trips_on(t.trips, _active(t, NEXT_DAY)).select("trip_id")
    return old.intersect(new).select(F.lit("kept").alias("part"), "trip_id").unionByName(
        old.exceptAll(new).select(F.lit("dropped").alias("part"), "trip_id"))


@query("ml05_model_table", """
select round(10 + 0.5::double * current_delay_s + 2 * stops_remaining - 4 * cast(active_alert_flag as integer), 6) as predicted,
 count(*) as n from v_observations group by 1""")
def _(t):
    path = scratch_path(t.spark, "model")
    md.save_model(t.spark, md.DelayModel(10.0, (0.5, 2.0, -4.0)), path, 1.0, 2.0)
    loaded = md.load_model(t.spark, path)
    return t.observations.groupBy(F.round(md.prediction(loaded), 6).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
