"""Queries over files and stored tables: scans, appends, upserts, archive and maintenance.

Each one writes what it needs from the driver tables into a fresh folder of the shared
scratch space and reads it back.
"""

from __future__ import annotations

import io
import zipfile
from datetime import date, datetime, timedelta, timezone

import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyspark.sql import functions as F

from signalbox.functions import punctuality as pu
from signalbox.functions.gtfstime import service_date
from signalbox.operators import archive as ar
from signalbox.operators import feeds as fd
from signalbox.operators import quality as qu
from signalbox.operators import rollups as ro
from signalbox.operators.schedule import WEEKDAYS
from signalbox.plans.canonical import Tables, epoch, ts
from signalbox.plans.feed_queries import _discrepancies
from signalbox.plans.registry import query
from signalbox.plans.rollup_queries import RANGE
from signalbox.schemas import EVENT_TABLES
from signalbox.session import scratch_path
from signalbox.sources import captures as cp
from signalbox.sources import static as ss
from signalbox.sources import store

NOW = datetime(2001, 1, 1, tzinfo=timezone.utc)


def _text(column):
    return F.col(column).cast("string").alias(column)


# --- timetable files ---


def _csv(t: Tables, df, name: str):
    path = scratch_path(t.spark, name)
    df.write.option("header", True).csv(path)
    return ss.read_csv(t.spark, path)


_CALENDAR = """
select 'C'||o_custkey as service_id, min(cast(o_orderdate as date)) as start_date, max(cast(o_orderdate as date)) as end_date,
 bool_or(isodow(o_orderdate) = 1) as monday, bool_or(isodow(o_orderdate) = 6) as saturday, bool_or(isodow(o_orderdate) = 7) as sunday
from orders group by 1"""


@query("src01_calendar_scan", f"""
select service_id, monday, saturday, sunday, strftime(start_date, '%Y-%m-%d') as start_date,
 strftime(end_date, '%Y-%m-%d') as end_date from ({_CALENDAR})""")
def _(t):
    day = F.to_date("o_orderdate")
    flags = [F.when(F.bool_or(F.weekday(day) == i), "1").otherwise("0").alias(n) for i, n in enumerate(WEEKDAYS)]
    files = t.raw("orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("service_id")).agg(
        *flags, F.date_format(F.min(day), "yyyyMMdd").alias("start_date"), F.date_format(F.max(day), "yyyyMMdd").alias("end_date"))
    parsed = ss.parse_calendar(_csv(t, files, "calendar"))
    return parsed.select("service_id", "monday", "saturday", "sunday", _text("start_date"), _text("end_date"))


@query("src02_calendar_dates_scan", """
select 'C'||o_custkey as service_id, strftime(o_orderdate, '%Y-%m-%d') as date, cast(1 + o_orderkey % 2 as integer) as exception_type
from orders""")
def _(t):
    files = t.raw("orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("service_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"), (F.col("o_orderkey") % 2 + 1).alias("exception_type"))
    return ss.parse_calendar_dates(_csv(t, files, "calendar_dates")).select("service_id", _text("date"), "exception_type")


@query("src03_trips_scan", """
select trip_id, route_id, service_id, headsign, case when trip_no % 7 <> 0 then direction_id end as direction_id, shape_id
from v_trips""")
def _(t):
    files = t.trips.select(
        "route_id", "service_id", "trip_id", F.col("headsign").alias("trip_headsign"),
        F.when(F.col("trip_no") % 7 != 0, F.col("direction_id")).alias("direction_id"), "shape_id")
    return ss.parse_trips(_csv(t, files, "trips"))


@query("src04_stop_times_scan", "select trip_id, stop_sequence, stop_id, arrival_time, departure_time from v_stop_times")
def _(t):
    files = t.stop_times.select("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence")
    return ss.parse_stop_times(_csv(t, files, "stop_times")).drop("pos")


@query("src05_stops_scan", """
select stop_id, name, parent_station, location_type, round(lat, 6) as lat, round(lon, 6) as lon, platform_code from v_stops""")
def _(t):
    files = t.stops.select(
        "stop_id", F.col("name").alias("stop_name"), F.round("lat", 6).alias("stop_lat"), F.round("lon", 6).alias("stop_lon"),
        "location_type", F.coalesce("parent_station", F.when(F.col("location_type") == 1, "ignored")).alias("parent_station"),
        "platform_code")
    return ss.parse_stops(_csv(t, files, "stops")).drop("wheelchair")


@query("src06_routes_scan", "select route_id, short_name, case when route_id = 'R3:' then '' else long_name end as long_name from v_routes")
def _(t):
    files = t.routes.select("route_id", F.col("short_name").alias("route_short_name"),
                            F.when(F.col("route_id") != "R3:", F.col("long_name")).alias("route_long_name"))
    return ss.parse_routes(_csv(t, files, "routes"))


ARCHIVED_TRIPS = 4096  # trips of one archive
_ODD = 'To "town",\nvia bridge'


def _zipped(t: Tables):
    """Timetable archives, each with one metro part of a few thousand trips and another mode beside it."""
    bucket = F.floor(F.col("trip_no") / ARCHIVED_TRIPS).alias("bucket")
    headsign = F.when(F.col("trip_no") % 11 == 0, _ODD).otherwise(F.col("headsign"))
    trips = t.trips.select(bucket, "trip_id", "route_id", "service_id", headsign.alias("trip_headsign"), "direction_id", "shape_id")
    calls = t.stop_times.select(bucket, "trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence")

    def zipped(files: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    def text(rows: pa.Table) -> bytes:
        rows = rows.drop_columns(["bucket"])
        out = io.BytesIO()
        try:
            csv.write_csv(rows, out, csv.WriteOptions(include_header=False, quoting_style="none"))
        except pa.ArrowInvalid:  # some value needs quotes
            body = rows.to_pandas().to_csv(index=False, header=False, lineterminator="\r\n").encode()
        else:
            body = out.getvalue().replace(b"\n", b"\r\n")
        return b"\xef\xbb\xbf" + ",".join(rows.column_names).encode() + b"\r\n" + body

    def pack(trips: pa.Table, calls: pa.Table) -> pa.Table:
        metro = zipped({"trips.txt": text(trips), "stop_times.txt": text(calls), "notes.pdf": b"%PDF"})
        other = zipped({"trips.txt": b"trip_id\nother\n"})
        return pa.table({"content": pa.array([zipped({"1/google_transit.zip": other, "2/google_transit.zip": metro})], pa.binary())})

    return trips.groupBy("bucket").cogroup(calls.groupBy("bucket")).applyInArrow(pack, "content binary")


@query("src08_archive_ingest", """
select t.trip_id, t.route_id, case when t.trip_no % 11 = 0 then 'To "town",' || chr(10) || 'via bridge' else coalesce(trim(headsign), '') end as headsign,
 t.direction_id, t.shape_id, count(s.stop_id) as calls, min(s.arrival_time) as first_arrival, max(s.stop_sequence) as last_sequence
from v_trips t join v_stop_times s using (trip_id) group by all""")
def _(t):
    path = scratch_path(t.spark, "archives")
    _zipped(t).write.parquet(path)
    lines = ss.unpacked(t.spark.read.parquet(path), members=("trips.txt", "stop_times.txt"), block_bytes=1 << 16)
    trips = ss.parse_trips(ss.member_rows(lines, "trips.txt", ["trip_id", "route_id", "service_id", "trip_headsign", "direction_id", "shape_id"]))
    calls = ss.parse_stop_times(ss.member_rows(lines, "stop_times.txt", ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"]))
    counted = calls.groupBy("digest", "trip_id").agg(
        F.count("stop_id").alias("calls"), F.min("arrival_time").alias("first_arrival"), F.max("stop_sequence").alias("last_sequence"))
    return trips.join(counted, ["digest", "trip_id"]).select(
        "trip_id", "route_id", "headsign", "direction_id", "shape_id", "calls", "first_arrival", "last_sequence")


# --- captures ---


def _stored_captures(t: Tables):
    path = scratch_path(t.spark, "captures")
    t.update_captures.write.json(path)
    return cp.read_captures(t.spark, path)


@query("src09_capture_scan", """
select count(*) as polls, cast(sum(case when k % 3 = 0 then 1 else 2 end) as bigint) as trips,
 min(ts_us) as first_us, max(ts_us) as last_us from v_events where event_type in ('purchase', 'signup')""")
def _(t):
    stored = _stored_captures(t)
    trips = fd.trip_updates(stored).agg(F.count(F.lit(1)).alias("trips"), F.lit(1).alias("_o"))
    at = F.unix_micros(F.to_timestamp("fetch_timestamp"))
    return stored.agg(F.count(F.lit(1)).alias("polls"), F.min(at).alias("first_us"), F.max(at).alias("last_us"),
                      F.lit(1).alias("_o")).join(trips, "_o").drop("_o")


@query("src10_light_scan", """
select ts_us as fetched_us, ts_us // 1000000 - k as header from v_events where event_type in ('purchase', 'signup')""")
def _(t):
    return cp.light(_stored_captures(t)).select(F.unix_micros("fetched_at").alias("fetched_us"), "header")


@query("src11_time_slice", """
select count(*) as polls, min(ts_us) as first_us, max(ts_us) as last_us from v_events
where event_type in ('purchase', 'signup') and ts >= TIMESTAMP '2024-01-10' and ts < TIMESTAMP '2024-01-20'""")
def _(t):
    path = scratch_path(t.spark, "slice")
    utc = timezone.utc
    cp.write_slice(cp.time_slice(_stored_captures(t), datetime(2024, 1, 10, tzinfo=utc), datetime(2024, 1, 20, tzinfo=utc)), path)
    at = F.unix_micros(F.to_timestamp("fetch_timestamp"))
    return cp.read_captures(t.spark, path).agg(F.count(F.lit(1)).alias("polls"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))


# --- event tables ---


def _completion_events(t: Tables):
    """Every trip update of the month as an outcome at its own instant."""
    at, delay = F.timestamp_micros("ts_us"), F.get("stop_time_updates", 0)["arr_delay"]
    status = F.when(F.col("relationship") == "CANCELED", "cancelled").otherwise(
        F.coalesce(pu.punctuality_status(delay), F.lit("undetermined_gap")))
    return t.snapshots.select(
        "event_id", "trip_id", "route_id", F.lit(None).cast("timestamp").alias("scheduled_terminus_arrival"),
        at.alias("actual_terminus_arrival"), delay.cast("int").alias("delay_seconds"), status.alias("status"),
        at.alias("observed_at"))


def _observation_events(t: Tables):
    return t.positions.select(
        "trip_id", "route_id", F.timestamp_micros("ts_us").alias("observed_at"), F.col("k").cast("int").alias("current_delay_s"),
        (F.col("k") % 9).cast("int").alias("stops_remaining"), (F.col("k") % 2 == 0).alias("active_alert_flag"))


_LOCAL_DAY = """cast(timezone('Australia/Melbourne', timezone('UTC', x)) as date)
 - case when hour(timezone('Australia/Melbourne', timezone('UTC', x))) < 3 then 1 else 0 end"""
_STORED = f"""
select {_LOCAL_DAY} as d, * from (select *, make_timestamp(s.ts_us) as x, case when relationship = 'CANCELED' then 'cancelled'
 when arr_delay <= 299 then 'on_time' when arr_delay is not null then 'late' else 'undetermined_gap' end as status
 from v_snap_stus s where idx = 0)"""
_STORED_OBS = f"""
select {_LOCAL_DAY} as d, * from (select *, make_timestamp(ts_us) as x from v_positions)"""
MONTH = [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]


def _stored_events(t: Tables, table: str, events):
    base = scratch_path(t.spark, "events")
    store.append_events(events, base, table, "observed_at")
    return base


def _count_by_day(df):
    return df.groupBy("service_date").agg(F.count(F.lit(1)).alias("n")).select(_text("service_date"), "n")


@query("snk01_event_append", f"select strftime(d, '%Y-%m-%d') as service_date, count(*) as n from ({_STORED}) group by d")
def _(t):
    base = _stored_events(t, "trip_completion_events", _completion_events(t))
    ddl = EVENT_TABLES["trip_completion_events"] + ", service_date date"
    return _count_by_day(store.read_table(t.spark, store.table_path(base, "trip_completion_events"), ddl))


def _known_days(t: Tables, table: str):
    days = t.polls.select(service_date(F.timestamp_micros("ts_us")).alias("service_date")).distinct().filter(
        F.dayofmonth("service_date") != 15)
    return days.select("service_date", F.lit(table).alias("table"), F.lit("d").alias("digest"))


def _day_read(t: Tables, table: str, events):
    base = _stored_events(t, table, events)
    store.register_days(t.spark, base, _known_days(t, table))
    store.register_days(t.spark, base, _known_days(t, table))  # known days stay as they are
    rows, coverage = store.read_days(t.spark, base, table, MONTH)
    counts = rows.groupBy("service_date").agg(F.count(F.lit(1)).alias("n"))
    return coverage.join(counts, "service_date", "left").select(
        _text("service_date"), "is_covered", F.coalesce("n", F.lit(0)).alias("n"))


_KNOWN = f"select {_LOCAL_DAY} from (select make_timestamp(ts_us) as x from v_polls) where day({_LOCAL_DAY}) <> 15"


def _day_read_sql(stored: str) -> str:
    return f"""
with r as (select cast(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-09', interval 1 day)) as date) as d),
 c as (select d, count(*) as n from ({stored}) group by d)
select strftime(r.d, '%Y-%m-%d') as service_date, r.d in ({_KNOWN}) as is_covered,
 coalesce(c.n, 0) as n from r left join c using (d)"""


@query("src13_completion_day_read", _day_read_sql(_STORED))
def _(t):
    return _day_read(t, "trip_completion_events", _completion_events(t))


@query("src14_observation_day_read", _day_read_sql(_STORED_OBS))
def _(t):
    return _day_read(t, "delay_observation_events", _observation_events(t))


@query("snk12_day_registry", f"""
select distinct strftime(d, '%Y-%m-%d') as service_date, 'trip_completion_events' as "table", 'd' as digest
from ({_KNOWN}) x(d)""")
def _(t):
    base = scratch_path(t.spark, "registry")
    for _ in range(2):
        store.register_days(t.spark, base, _known_days(t, "trip_completion_events"))
    return store.read_registry(t.spark, base).select(_text("service_date"), "table", "digest")


@query("set04_missing_days", """
select strftime(d, '%Y-%m-%d') as service_date from (select cast(unnest(generate_series(TIMESTAMP '1995-01-01',
 TIMESTAMP '1998-06-15', interval 1 day)) as date) as d) where d not in (select start_date from v_trips)""")
def _(t):
    known = t.trips.select(F.col("start_date").alias("service_date")).distinct()
    return store.missing_days(ro.day_spine(t.spark, RANGE), known).select(_text("service_date"))


@query("snk05_rollup_upsert", f"""
with f as (select * from ({_STORED}) qualify row_number() over (partition by d, trip_id order by ts_us, event_id) = 1)
select strftime(d, '%Y-%m-%d') as service_date, route_id, count(*) filter (status = 'on_time') as on_time_count,
 count(*) filter (status = 'late') as late_count, count(*) filter (status = 'cancelled') as cancelled_count,
 count(*) filter (status = 'undetermined_gap') as gap_count, cast(0 as bigint) as replacement_bus_count
from f where route_id is not null group by all""")
def _(t):
    path = scratch_path(t.spark, "line_rollups")
    events = _completion_events(t).withColumn("service_date", service_date("observed_at"))
    days = ro.line_day_rollup(ro.first_completions(events, ["observed_at", "event_id"]), t.routes)
    store.upsert_days(days, path)
    # rolling a part of the days up again replaces them, it does not add to them
    store.upsert_days(days.filter(F.dayofmonth("service_date") > 10), path)
    return t.spark.read.parquet(path).select(_text("service_date"), "route_id", *ro.LINE_COUNTS)


@query("snk06_digest_append", """
with x as (select cast(date_trunc('week', service_date) as date) as w, route_id, count(*) filter (status in ('on_time', 'late')) as n
 from v_completions group by all)
select strftime(w, '%Y-%m-%d') as week_start, count(*) filter (route_id is not null and n >= 3) as lines from x group by w""")
def _(t):
    base = scratch_path(t.spark, "digests")
    store.append_digest(ro.weekly_network_stats(t.completions), ro.weekly_line_stats(t.completions, 3), base)
    digests, lines = (t.spark.read.parquet(store.table_path(base, n)) for n in ("weekly_digests", "weekly_digest_line_stats"))
    counts = lines.groupBy("week_start").agg(F.count(F.lit(1)).alias("lines"))
    return digests.select("week_start").join(counts, "week_start", "left").select(
        _text("week_start"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("snk07_pin_first_write", """
select strftime(d, '%Y-%m-%d') as service_date, case when month(d) <= 6 then 'first' else 'second' end as digest
from (select distinct cast(o_orderdate as date) as d from orders)""")
def _(t):
    path = scratch_path(t.spark, "pins")
    days = t.raw("orders").select(F.to_date("o_orderdate").alias("service_date")).distinct()
    store.pin_first(t.spark, path, days.filter(F.month("service_date") <= 6).withColumn("digest", F.lit("first")))
    store.pin_first(t.spark, path, days.withColumn("digest", F.lit("second")))
    return t.spark.read.parquet(path).select(_text("service_date"), "digest")


@query("snk11_snapshot_store", "select digest, count(*) as n from v_trips group by digest")
def _(t):
    path = scratch_path(t.spark, "static")
    store.store_snapshot(t.trips, path, t.trips.select("digest").limit(0))
    store.store_snapshot(t.trips, path, t.spark.read.parquet(path))  # every digest is known now
    return t.spark.read.parquet(path).groupBy(_text("digest")).agg(F.count(F.lit(1)).alias("n"))


_REPORT = """select distinct cast(o_orderdate as date) as d, day(o_orderdate) % 2 = 0 as recovered from orders"""


@query("snk08_gap_report", f"""
select strftime(d, '%Y-%m-%d') as service_date, recovered, DATE '2001-01-01' - d > 53 as permanent from ({_REPORT})
where cast(d as timestamp) >= TIMESTAMP '2001-01-01' - interval 182 day""")
def _(t):
    path = scratch_path(t.spark, "gap_report")
    day = F.to_date("o_orderdate")
    entries = t.raw("orders").select(day.alias("service_date")).distinct().select(
        "service_date", F.col("service_date").cast("timestamp").alias("detected_at"), F.lit("restored_from_backup").alias("reason"),
        (F.dayofmonth("service_date") % 2 == 0).alias("recovered"),
        pu.is_permanent_gap(F.col("service_date"), F.lit(NOW.date())).alias("permanent"))
    store.append_gap_report(entries, path)
    store.prune_gap_report(t.spark, path, NOW)
    return store.read_gap_report(t.spark, path).select(_text("service_date"), "recovered", "permanent")


@query("scl26_gap_permanence", f"select strftime(d, '%Y-%m-%d') as service_date, DATE '2001-01-01' - d > 53 as permanent from ({_REPORT})")
def _(t):
    days = t.raw("orders").select(F.to_date("o_orderdate").alias("service_date")).distinct()
    return days.select(_text("service_date"), pu.is_permanent_gap(F.col("service_date"), F.lit(NOW.date())).alias("permanent"))


def _order_days(t: Tables):
    return t.raw("orders").select(F.to_date("o_orderdate").alias("service_date")).distinct()


@query("snk09_days_to_copy", """
select strftime(d, '%Y-%m-%d') as service_date from (select distinct cast(o_orderdate as date) as d from orders)
where day(d) % 5 <> 0 and timezone('UTC', TIMESTAMP '2001-01-01') >=
 timezone('Australia/Melbourne', cast(d + 1 as timestamp) + interval 3 hour) + interval 30 minute""")
def _(t):
    backup = _order_days(t).filter(F.dayofmonth("service_date") % 5 == 0)
    return store.days_to_copy(_order_days(t), backup, ts(NOW)).select(_text("service_date"))


@query("snk10_retention_plan", """
select strftime(d, '%Y-%m-%d') as service_date, case when DATE '2001-01-01' - d <= 60 then 'keep'
 when day(d) % 5 <> 0 then 'delete' else 'skipped_not_backed_up' end as action
from (select distinct cast(o_orderdate as date) as d from orders)""")
def _(t):
    backup = _order_days(t).filter(F.dayofmonth("service_date") % 5 != 0)
    return store.retention_plan(_order_days(t), F.lit(NOW.date()), must_be_in=backup).select(_text("service_date"), "action")


@query("src16_primary_else_backup", """
select strftime(d, '%Y-%m-%d') as service_date, case when day(d) % 7 <> 0 then 'primary' when day(d) % 3 <> 0 then 'backup' end as path,
 day(d) % 7 = 0 and day(d) % 3 <> 0 as recovered from (select distinct cast(o_orderdate as date) as d from orders)""")
def _(t):
    day = F.dayofmonth("service_date")
    primary = _order_days(t).filter(day % 14 != 0).select("service_date", F.lit("primary").alias("path"), (day % 7 != 0).alias("is_readable"))
    backup = _order_days(t).select("service_date", F.lit("backup").alias("path"), (day % 3 != 0).alias("is_readable"))
    return store.choose_partitions(primary, backup).select(_text("service_date"), "path", "recovered")


# --- archive ---


def _ghosts(t: Tables):
    """Vehicle fixes as ghost episodes, one per fix."""
    at = F.timestamp_micros("ts_us")
    none = F.lit(None)
    return t.positions.select(
        at.alias("recorded_at"), "trip_id", at.alias("last_seen_at"), F.col("lat").alias("last_seen_lat"),
        F.col("lon").alias("last_seen_lon"), none.cast("timestamp").alias("reappeared_at"), none.cast("double").alias("reappear_lat"),
        none.cast("double").alias("reappear_lon"), F.lit(False).alias("loop_contained"), F.col("k").cast("double").alias("ghost_duration_s"),
        F.lit(False).alias("backoff_overlapped"), F.when(F.col("k") % 2 == 0, "timed_out").otherwise("reappeared").alias("reason"),
        service_date(at).alias("service_date"))


def _gap_events(t: Tables):
    polls = t.polls.withColumn("at", F.floor(F.col("ts_us") / 1_000_000).cast("bigint"))
    gaps = qu.outage_episodes(polls, tie="poll_id")
    return gaps.select(
        F.timestamp_seconds("ended_at").alias("recorded_at"), F.timestamp_seconds("started_at").alias("started_at"),
        F.timestamp_seconds("ended_at").alias("ended_at"), F.lit("circuit_breaker").alias("reason"),
        F.col("consecutive_failures").cast("int").alias("consecutive_failures"), "max_level_reached_s",
        service_date(F.timestamp_seconds("started_at")).alias("service_date"))


_GAPS_SQL = f"""select {_LOCAL_DAY.replace('(x', '(x').replace("'UTC', x", "'UTC', to_timestamp(started_at)::timestamp")} as d from v_outages"""
_GHOSTS_SQL = f"""select {_LOCAL_DAY} as d, * from (select *, make_timestamp(ts_us) as x from v_positions)"""


@query("src15_evolving_schema_read", """
select strftime(make_timestamp(ts_us), '%Y-%m') as month, count(*) as n, count(*) filter (ts_us >= 1705276800000000 and k % 2 = 0) as timed_out,
 count(*) filter (ts_us >= 1705276800000000) as with_reason from v_positions group by 1""")
def _(t):
    base = scratch_path(t.spark, "evolving")
    path, border = store.table_path(base, "ghost_events"), F.timestamp_seconds(F.lit(1705276800))
    ghosts = _ghosts(t)
    ghosts.filter(F.col("last_seen_at") < border).drop("reason").write.mode("append").parquet(path)  # first schema version
    ghosts.filter(F.col("last_seen_at") >= border).write.mode("append").parquet(path)
    rows = store.read_table(t.spark, path, EVENT_TABLES["ghost_events"])
    return rows.groupBy(F.date_format("last_seen_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "timed_out").alias("timed_out"), F.count("reason").alias("with_reason"))


@query("join24_gap_marker_fanout", f"""
with g as ({_GAPS_SQL}), e as ({_GHOSTS_SQL})
select strftime(d, '%Y-%m-%d') as service_date, is_gap_marker, count(*) as n, count(trip_id) as with_trip from (
 select d, false as is_gap_marker, trip_id from e union all select d, true, null from g) group by all""")
def _(t):
    rows = ar.archive_table(_ghosts(t), _gap_events(t), "ghost_events")
    return rows.groupBy("service_date", "is_gap_marker").agg(F.count(F.lit(1)).alias("n"), F.count("trip_id").alias("with_trip")).select(
        _text("service_date"), "is_gap_marker", "n", "with_trip")


@query("prj10_archive_base_columns", f"""
select strftime(d, '%Y-%m-%d') as service_date, 2 as schema_version, count(*) as n from ({_GHOSTS_SQL}) group by d""")
def _(t):
    rows = ar.with_base_columns(_ghosts(t))
    return rows.groupBy("service_date", "schema_version").agg(F.count(F.lit(1)).alias("n")).select(
        _text("service_date"), "schema_version", "n")


@query("flt02_without_gap_markers", f"select strftime(d, '%Y-%m-%d') as service_date, count(*) as n from ({_GHOSTS_SQL}) group by d")
def _(t):
    return _count_by_day(ar.without_markers(ar.archive_table(_ghosts(t), _gap_events(t), "ghost_events")))


def _discrepancy_events(t: Tables):
    at = F.timestamp_seconds(F.col("cycle") * 21600)
    return _discrepancies(t).select(
        at.alias("recorded_at"), "trip_id", at.alias("observed_at"),
        F.when(F.col("cycle") % 10 == 0, F.concat("discrepancy_type", F.lit("_v2"))).otherwise(F.col("discrepancy_type")).alias("discrepancy_type"),
        "tu_value", "vp_value", service_date(at).alias("service_date"))


@query("agg20_vocabulary_drift", """
select 'discrepancy_events' as "table", 'discrepancy_type' as "column", discrepancy_type||'_v2' as value, count(*) as n
from v_discrepancies where cycle % 10 = 0 group by 3""")
def _(t):
    return ar.drift({"discrepancy_events": _discrepancy_events(t), "trip_completion_events": t.completions})


@query("agg21_table_counts", """
select 'discrepancy_events' as "table", count(*) as n from v_discrepancies union all
select 'ghost_events', count(*) from v_positions union all select 'poll_gap_events', count(*) from v_outages union all
select 'trip_completion_events', count(*) from v_completions union all select 'delay_observation_events', count(*) from v_observations""")
def _(t):
    return qu.table_counts({
        "discrepancy_events": _discrepancies(t), "ghost_events": _ghosts(t), "poll_gap_events": _gap_events(t),
        "trip_completion_events": t.completions, "delay_observation_events": t.observations})


@query("agg28_event_counters", """
select 'discrepancies' as event, discrepancy_type as label, count(*) as n from v_discrepancies group by 2 union all
select 'completions', status, count(*) from v_completions group by 2 union all
select 'gaps', '', count(*) from v_outages union all select 'polls', cast(ok as varchar), count(*) from v_polls group by 2""")
def _(t):
    return qu.event_counts(
        {"discrepancies": _discrepancies(t), "completions": t.completions, "gaps": _gap_events(t), "polls": t.polls},
        {"discrepancies": "discrepancy_type", "completions": "status", "polls": "ok"})


def _archived(t: Tables):
    """An archive of two tables for the days of the event data."""
    base = scratch_path(t.spark, "archive")
    days = _ghosts(t).select("service_date").unionByName(_gap_events(t).select("service_date")).distinct()
    gaps = _gap_events(t)
    for table, rows in (("ghost_events", ar.archive_table(_ghosts(t), gaps, "ghost_events")),
                        ("poll_gap_events", ar.archive_table(gaps, gaps, "poll_gap_events"))):
        ar.write_archive(rows, base, table)
    for table in ("discrepancy_events", "trip_completion_events", "delay_observation_events"):
        late = F.dayofmonth("service_date") > 3 if table == "discrepancy_events" else F.lit(True)
        ar.record_empty_days(t.spark, base, days.filter(late).select("service_date", F.lit(table).alias("table")))
    return base, days


_ARCHIVED_DAYS = f"with g as ({_GAPS_SQL}), e as ({_GHOSTS_SQL}), u as (select d from e union select d from g)"


@query("snk02_archive_write", f"""
{_ARCHIVED_DAYS} select strftime(d, '%Y-%m-%d') as service_date, is_gap_marker, count(*) as n from (
 select d, false as is_gap_marker from e union all select d, true from g) group by all""")
def _(t):
    base, _days = _archived(t)
    rows = ar.read_archive(t.spark, base, "ghost_events")
    return rows.groupBy("service_date", "is_gap_marker").agg(F.count(F.lit(1)).alias("n")).select(
        _text("service_date"), "is_gap_marker", "n")


@query("snk03_empty_day_manifest", f"""
{_ARCHIVED_DAYS} select strftime(d, '%Y-%m-%d') as service_date, x as "table" from u,
 (values ('discrepancy_events'), ('trip_completion_events'), ('delay_observation_events')) v(x)
where x <> 'discrepancy_events' or day(d) > 3""")
def _(t):
    base, days = _archived(t)
    again = days.filter(F.dayofmonth("service_date") > 3).select("service_date", F.lit("discrepancy_events").alias("table"))
    ar.record_empty_days(t.spark, base, again)  # recording a day twice keeps it once
    return store.read_table(t.spark, f"{base}/_empty_days", ar.MANIFEST).select(_text("service_date"), "table")


@query("snk04_fully_archived_days", f"""
{_ARCHIVED_DAYS} select strftime(d, '%Y-%m-%d') as service_date from u where day(d) > 3 and d in (select d from e) and d in (select d from g)""")
def _(t):
    base, _days = _archived(t)
    return ar.fully_archived(ar.archived_days(t.spark, base)).select(_text("service_date"))


@query("set06_archived_day_union", f"{_ARCHIVED_DAYS} select strftime(d, '%Y-%m-%d') as service_date from u")
def _(t):
    base, _days = _archived(t)
    return ar.archived_days(t.spark, base).select("service_date").distinct().select(_text("service_date"))


@query("agg30_archive_backlog", f"""
{_ARCHIVED_DAYS} select count(*) as days_pending, max(DATE '2024-03-01' - d)::integer as oldest_age_days from u
where not (day(d) > 3 and d in (select d from e) and d in (select d from g))""")
def _(t):
    base, days = _archived(t)
    return ar.backlog(days, ar.archived_days(t.spark, base), F.lit(date(2024, 3, 1)))


@query("agg31_latest_archived", f"{_ARCHIVED_DAYS} select strftime(max(d), '%Y-%m-%d') as latest_archived_date from u")
def _(t):
    base, _days = _archived(t)
    return ar.latest_archived(ar.archived_days(t.spark, base)).select(_text("latest_archived_date"))


@query("str16_archive_pass", f"""
{_ARCHIVED_DAYS}, b as (select distinct d from e), k as (select d from u where day(d) % 4 <> 3)
select 'archived' as outcome, count(*) as n from k union all
select 'failed', count(*) from u where day(d) % 4 = 3 union all
select 'recovered', count(*) from k where day(d) % 4 = 2 union all
select 'ghost_rows', (select count(*) from e where d in (select d from k)) + (select count(*) from g where d in (select d from k))""")
def _(t):
    spark = t.spark
    primary, backup, archive = (scratch_path(spark, n) for n in ("primary", "backup", "archive"))
    ghosts, gaps = _ghosts(t), _gap_events(t)
    days = ghosts.select("service_date").unionByName(gaps.select("service_date")).distinct()
    part = F.dayofmonth("service_date") % 4
    for base, keep in ((primary, part < 2), (backup, part == 2)):
        for table, rows in (("ghost_events", ghosts), ("poll_gap_events", gaps)):
            store._write(rows.filter(keep), store.table_path(base, table), ["service_date"], "append")
        store.register_days(spark, base, days.filter(keep).select(
            "service_date", F.lit("ghost_events").alias("table"), F.lit("d").alias("digest")))
    days.write.parquet(store.table_path(primary, "_expected_days"))
    result = ar.run_archive_pass(spark, primary, backup, archive, scratch_path(spark, "report"), datetime(2024, 3, 1, tzinfo=timezone.utc))
    count = lambda name: result[name].agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"))
    written = ar.read_archive(spark, archive, "ghost_events").agg(F.lit("ghost_rows").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return count("archived").unionByName(count("failed")).unionByName(count("recovered")).unionByName(written)
