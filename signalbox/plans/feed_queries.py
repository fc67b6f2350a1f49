"""Queries over captured feeds: flattening, merging, quality, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbox.functions import geo, gtfstime as gt
from signalbox.operators import alerts as al
from signalbox.operators import feeds as fd
from signalbox.operators import quality as qu
from signalbox.operators import schedule as sc
from signalbox.plans.canonical import FEED_NOW, Tables, epoch, ts
from signalbox.plans.registry import query
from signalbox.session import checkpointed

CYCLE_US = 21_600_000_000
SHIFT_S = 806_198_400  # moves January 2024 onto the timetable's June/July 1998


def _now():
    return ts(FEED_NOW)


def _cycle(df):
    return df.withColumn("cycle", F.floor(F.col("ts_us") / CYCLE_US).cast("bigint"))


def _last(df):
    rest = [c for c in df.columns if c not in ("cycle", "trip_id")]
    return df.groupBy("cycle", "trip_id").agg(
        F.max_by(F.struct(*rest), F.struct("ts_us", "event_id")).alias("_e")).select("cycle", "trip_id", "_e.*")


def merged(t: Tables):
    tu = _last(_cycle(t.trip_updates)).drop("event_id").withColumnRenamed("ts_us", "schedule_us")
    vp = _last(_cycle(t.positions)).select(
        "cycle", "trip_id", "lat", "lon", F.col("ts_us").alias("position_us"),
        *[F.col(c).alias(f"vp_{c}") for c in ("route_id", "start_time", "start_date")])
    return fd.merge_feeds(tu, vp, "cycle")


def _discrepancies(t: Tables):
    return fd.discrepancies(merged(t), "cycle", ("route_id", "start_time", "start_date"))


def _seconds(df, column="ts_us"):
    return df.withColumn("at", F.floor(F.col(column) / 1_000_000).cast("bigint"))


_TU_ENTITIES = """
select event_id, ts_us, pos, k, ts_us // 1000000 - k as header_s,
 cast(case when pos = 1 and k % 3 <> 0 then user_id + 1000 else user_id end as varchar) as trip_id,
 'R'||((user_id + pos) % 20)||':' as route_id, strftime(ts, '%Y%m%d') as start_date,
 case when k % 25 = 0 then 'CANCELED' else 'SCHEDULED' end as schedule_relationship,
 case when k % 4 <> 0 then k + pos end as arr_delay, case when k % 5 <> 0 then k - pos end as dep_delay,
 case when k % 4 <> 0 then cast(ts_us // 1000000 as varchar) end as arr_time
from v_events, (values (0), (1)) as x(pos) where event_type in ('purchase', 'signup')"""


@query("prj01_flatten_trip_updates", f"""
select ts_us as cycle_us, trip_id, route_id, start_date, schedule_relationship, header_s from ({_TU_ENTITIES})
qualify row_number() over (partition by ts_us, trip_id order by pos desc) = 1""")
def _(t):
    return fd.trip_updates(t.update_captures).select(
        F.unix_micros("cycle_at").alias("cycle_us"), "trip_id", "route_id", "start_date", "schedule_relationship",
        epoch("schedule_updated_at").alias("header_s"))


@query("prj02_flatten_vehicle_positions", """
select ts_us as cycle_us, cast(user_id as varchar) as trip_id,
 round(cast(-37.82 as double) + (k % 20) * cast(0.001 as double), 6) as lat,
 case when k % 3 <> 0 then ts_us // 1000000 - 5 else ts_us // 1000000 end as position_s
from v_events where event_type in ('view', 'click')""")
def _(t):
    return fd.vehicle_positions(t.vehicle_captures).select(
        F.unix_micros("cycle_at").alias("cycle_us"), "trip_id", F.round("lat", 6).alias("lat"),
        epoch("position_updated_at").alias("position_s"))


@query("prj03_flatten_stop_time_updates", f"""
select ts_us as cycle_us, trip_id, cast(0 as bigint) as pos, k % 12 + 1 as stop_sequence, arr_delay, dep_delay, arr_time
from ({_TU_ENTITIES} qualify row_number() over (partition by ts_us, trip_id order by pos desc) = 1)""")
def _(t):
    rows = fd.long_stop_time_updates(fd.trip_updates(t.update_captures))
    as_long = [F.col(c).cast("bigint").alias(c) for c in ("pos", "stop_sequence", "arr_delay", "dep_delay")]
    return rows.select(F.unix_micros("cycle_at").alias("cycle_us"), "trip_id", *as_long, "arr_time")


_ALERTS = """
select cast(p_partkey as varchar) as id, case when p_partkey % 6 = 0 then 'REPLACED' else p_type end as effect,
 case p_partkey % 3 when 0 then p_name when 1 then p_brand end as header_text, p_name as description_text,
 case when p_partkey % 14 <> 0 and p_partkey % 7 <> 0 then 1704067200 + (p_partkey % 30) * 86400 end as start_s,
 case when p_partkey % 14 <> 0 then 1704067200 + (p_partkey % 30 + p_size) * 86400 end as end_s,
 case when p_partkey % 11 <> 0 and p_partkey % 3 <> 0 then 'R'||(p_partkey % 20)||':' end as route_id,
 cast(case when p_partkey % 11 <> 0 then 1 else 0 end as integer) as entities from part"""


def _parsed_alerts(t: Tables):
    return al.alerts_of(t.alert_captures)


@query("prj04_flatten_alerts", f"select id, effect, entities from ({_ALERTS})")
def _(t):
    return _parsed_alerts(t).select("id", "effect", F.size("informed_entities").alias("entities"))


@query("prj05_translation_pick", f"select id, header_text, description_text, cast(null as varchar) as url from ({_ALERTS})")
def _(t):
    return _parsed_alerts(t).select("id", "header_text", "description_text", "url")


@query("prj06_periods_and_entities", f"select id, start_s, end_s, route_id from ({_ALERTS})")
def _(t):
    p, e = F.get("active_periods", 0), F.get("informed_entities", 0)
    return _parsed_alerts(t).select("id", epoch(p["start_at"]).alias("start_s"), epoch(p["end_at"]).alias("end_s"),
                                    e["route_id"].alias("route_id"))


@query("prj07_epoch_coercion", """
select event_type, count(*) as n, count(case when k % 9 <> 0 then 1 end) as readable,
 cast(sum(case when k % 9 <> 0 then ts_us // 1000000 end) as bigint) as total from v_events group by event_type""")
def _(t):
    text = F.when(F.col("k") % 9 != 0, F.floor(F.col("ts_us") / 1_000_000).cast("bigint").cast("string")).otherwise("soon")
    at = fd.epoch_instant(text)
    return t._events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(at).alias("readable"),
                                               F.sum(epoch(at)).alias("total"))


@query("prj08_freshness_flags", """
select cycle, count(*) filter (schedule_us is not null) as with_schedule,
 count(*) filter (position_us is not null) as with_position, count(*) as trips from v_merged group by cycle""")
def _(t):
    return merged(t).groupBy("cycle").agg(
        F.count_if(fd.has_schedule("schedule_us")).alias("with_schedule"),
        F.count_if(fd.has_position("position_us")).alias("with_position"), F.count(F.lit(1)).alias("trips"))


@query("prj14_service_date_resolution", """
select strftime(coalesce(case when event_id % 5 <> 0 then cast(ts as date) end,
 cast(timezone('Australia/Melbourne', timezone('UTC', ts)) as date)
  - case when hour(timezone('Australia/Melbourne', timezone('UTC', ts))) < 3 then 1 else 0 end), '%Y-%m-%d') as service_date,
 count(*) as n from v_events where event_type in ('purchase', 'signup') group by 1""")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, "2024XX01").otherwise(F.col("start_date"))
    day = gt.resolve_service_date(text, F.timestamp_micros("ts_us"))
    return t.trip_updates.groupBy(day.cast("string").alias("service_date")).agg(F.count(F.lit(1)).alias("n"))


@query("scl06_parse_start_date", """
select strftime(case when event_id % 5 <> 0 then cast(ts as date) end, '%Y-%m-%d') as start_day, count(*) as n
from v_events where event_type in ('purchase', 'signup') group by 1""")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, "20241399").otherwise(F.col("start_date"))
    return t.trip_updates.groupBy(gt.parse_start_date(text).cast("string").alias("start_day")).agg(F.count(F.lit(1)).alias("n"))


@query("join01_feed_merge", """
select cycle, trip_id, route_id, start_date, start_time, delay, schedule_us, position_us, round(lat, 6) as lat,
 round(lon, 6) as lon, in_tu, in_vp from v_merged""")
def _(t):
    return merged(t).select("cycle", "trip_id", "route_id", "start_date", "start_time", "delay", "schedule_us",
                            "position_us", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "in_tu", "in_vp")


@query("join02_discrepancies", "select * from v_discrepancies")
def _(t):
    return _discrepancies(t)


@query("win02_newly_raised_discrepancies", """
select * exclude (before) from (select *, lag(cycle) over (partition by trip_id, discrepancy_type order by cycle) as before
 from v_discrepancies) where before is null or cycle - before > 1""")
def _(t):
    return fd.newly_raised(_discrepancies(t), "cycle")


def _polls(t: Tables):
    return t.polls.withColumn("at", F.floor(F.col("ts_us") / 1_000_000).cast("bigint")).withColumn("header", F.col("header_ts"))


def _exact_polls(t: Tables):
    return t.polls.filter("ok").select("poll_id", "feed", (F.col("ts_us") / 1_000_000.0).alias("at"),
                                       F.col("header_ts").alias("header"))


@query("win05_header_changes", "select poll_id, feed, is_change, cast(step as bigint) as step from v_header_changes")
def _(t):
    return fd.header_changes(_exact_polls(t), "feed", "at", "header", tie="poll_id").select(
        "poll_id", "feed", "is_change", F.col("interval").alias("step"))


@query("agg18_cadence", """
select feed, count(*) as n_polls, count(*) filter (is_change) as n_header_changes,
 cast(min(step) as double) as interval_min, cast(max(step) as double) as interval_max,
 round(max(at - header)::double, 4) as age_max,
 round(quantile_cont(step, 0.5)::double, 4) as interval_p50, round(quantile_cont(step, 0.9)::double, 4) as interval_p90,
 round(quantile_cont((at - header)::double, 0.5), 4) as age_p50,
 round(quantile_cont((at - header)::double, 0.9), 4) as age_p90,
 round(quantile_cont((at - header)::double, 0.99), 4) as age_p99 from v_header_changes group by feed""")
def _(t):
    c = qu.cadence(_exact_polls(t))
    rounded = ("age_max", "interval_p50", "interval_p90", "age_p50", "age_p90", "age_p99")
    return c.withColumns({x: F.round(x, 4) for x in rounded})


@query("agg15_field_population", """
select field, count(*) as total_entities, count(*) filter (filled) as filled,
 round(100.0::double * count(*) filter (filled) / count(*), 6) as filled_pct
from (select unnest(['position.latitude', 'position.longitude', 'position.bearing', 'position.speed', 'stop_id',
  'current_status', 'occupancy_status', 'vehicle.id', 'vehicle.label', 'trip.trip_id', 'trip.route_id',
  'trip.direction_id', 'trip.schedule_relationship']) as field,
  unnest([true, true, k % 2 = 0, false, k % 4 = 0, k % 7 <> 0, false, true, k % 6 <> 0, true, k % 10 <> 0, true, false])
   as filled from v_events where event_type in ('view', 'click')) group by field""")
def _(t):
    vehicles = t.vehicle_captures.select(F.explode("feed.entity.vehicle").alias("v")).filter("v is not null").select("v.*")
    return qu.field_population(vehicles).withColumn("filled_pct", F.round("filled_pct", 6))


_HOUR = "hour(timezone('Australia/Melbourne', to_timestamp(at)))"


@query("agg16_capture_summary", f"""
select feed, min(at) filter (ok) as window_start, max(at) filter (ok) as window_end,
 round((max(at) filter (ok) - min(at) filter (ok)) / 3600.0::double, 6) as hours_covered,
 count(*) as polls_attempted, count(*) filter (ok) as polls_succeeded,
 bool_or(ok and {_HOUR} between 7 and 8) as am_peak, bool_or(ok and {_HOUR} between 16 and 17) as pm_peak,
 bool_or(ok and {_HOUR} between 1 and 3) as overnight
from (select *, ts_us // 1000000 as at from v_polls) group by feed""")
def _(t):
    return qu.capture_summary(_polls(t)).withColumn("hours_covered", F.round("hours_covered", 6))


@query("agg16_error_counts", "select feed, error, count(*) as n from v_polls where not ok group by all")
def _(t):
    return qu.error_counts(t.polls)


@query("agg19_zero_entity_overnight", f"""
select count(*) as overnight_polls, count(*) filter (n_entities = 0) as zero_entity_polls,
 round(100.0::double * count(*) filter (n_entities = 0) / count(*), 6) as zero_entity_pct,
 count(distinct header_ts) filter (n_entities = 0) > 1 as header_advances
from (select *, ts_us // 1000000 as at from v_polls) where {_HOUR} between 1 and 3""")
def _(t):
    return qu.zero_entity_overnight(_polls(t)).withColumn("zero_entity_pct", F.round("zero_entity_pct", 6))


@query("src12_rate_limit_windows", """
select poll_id, case when poll_id % 9 = 0 then null else k end as minute_left,
 case when poll_id % 9 = 0 then null else k * 10 end as day_left,
 cast(case when poll_id % 9 = 0 then 0 else 2 end as integer) as windows
from (select poll_id, remaining as k from v_polls)""")
def _(t):
    parsed = t.polls.select("poll_id", qu.parse_rate_limits(_limits()).alias("w"))
    return parsed.select("poll_id", F.get("w", 0)["remaining"].alias("minute_left"),
                         F.get("w", 1)["remaining"].alias("day_left"), F.size("w").alias("windows"))


def _limits():
    k = F.col("remaining").cast("string")
    text = F.concat(F.lit('[{"window":"minute","type":"key","remaining":'), k,
                    F.lit('},{"window":"day","type":"key","remaining":'), (F.col("remaining") * 10).cast("string"),
                    F.lit("}]"))
    return F.when(F.col("poll_id") % 9 == 0, F.lit("not json")).otherwise(text)


@query("agg34_lowest_remaining", """
select ts_us // 21600000000 as cycle, min(least(remaining, remaining * 10)) filter (poll_id % 9 <> 0) as lowest_remaining
from v_polls group by 1""")
def _(t):
    return qu.lowest_remaining_per_cycle(_cycle(t.polls).withColumn("limits", _limits()), "cycle", "limits")


@query("agg36_feed_age", """
select feed, max(at) filter (is_change) as last_changed_at, 1705363200 - max(at) filter (is_change) as age_s,
 1705363200 - max(at) filter (is_change) > 300 as is_stale from (
 select feed, ts_us // 1000000 as at, row_number() over w = 1 or header_ts is distinct from lag(header_ts) over w as is_change
 from v_polls window w as (partition by feed order by ts_us)) group by feed""")
def _(t):
    return qu.feed_age(_polls(t), F.lit(int(FEED_NOW.timestamp())), tie="poll_id")


@query("flt12_stale_feeds", """
select feed from (select feed, max(ts_us // 1000000) filter (is_change) as c from (
 select *, row_number() over w = 1 or header_ts is distinct from lag(header_ts) over w as is_change
 from v_polls window w as (partition by feed order by ts_us)) group by feed) where 1706659200 - c > 600""")
def _(t):
    return qu.feed_age(_polls(t), F.lit(1706659200), stale_after_s=600, tie="poll_id").filter("is_stale").select("feed")


@query("agg37_poll_outcomes", """
select ts_us // 86400000000 * 86400 as window_start, count(*) filter (ok) as ok_polls,
 count(*) filter (not ok) as failed_polls, min(remaining) as lowest_remaining from v_polls group by 1""")
def _(t):
    return qu.poll_outcomes(_polls(t), 86400)


@query("agg29_discrepancy_ratio", """
with d as (select cycle * 21600 // 86400 * 86400 as w, count(*) as n from v_discrepancies group by 1),
 p as (select ts_us // 86400000000 * 86400 as w, count(*) as n from v_polls where ok group by 1)
select p.w as window_start, p.n as ok_polls, coalesce(d.n, 0) as discrepancies,
 round(coalesce(d.n, 0)::double / p.n, 6) as ratio from p left join d on d.w = p.w""")
def _(t):
    found = _discrepancies(t).withColumn("at", F.col("cycle") * 21600)
    return qu.discrepancy_ratio(found, _polls(t), 86400).withColumn("ratio", F.round("ratio", 6))


@query("win11_outage_episodes", """
select started_at, ended_at, bad_cycles, consecutive_failures,
 cast(case when bad_cycles = 1 then 30 when bad_cycles = 2 then 60 else 300 end as double) as max_level_reached_s
from v_outages""")
def _(t):
    return qu.outage_episodes(_polls(t), tie="poll_id")


@query("flt11_valid_fixes", """
select trip_id, count(*) as fixes from v_positions where event_id % 10 <> 0 and k % 7 <> 0 group by trip_id""")
def _(t):
    holes = t.positions.withColumns({"lat": F.when(F.col("event_id") % 10 != 0, F.col("lat")),
                                     "lon": F.when(F.col("k") % 7 != 0, F.col("lon"))})
    return qu.valid_fixes(holes).groupBy("trip_id").agg(F.count(F.lit(1)).alias("fixes"))


def _fixes(t: Tables):
    return _seconds(qu.valid_fixes(t.positions)).select("event_id", "trip_id", "at", "lat", "lon")


def _gaps(t: Tables):
    return fd.consecutive_fixes(_fixes(t), "trip_id", "at", "event_id")


@query("win06_consecutive_fixes", """
select event_id, trip_id, at, next_at, gap_s, round(distance_m, 3) as distance_m from v_gaps""")
def _(t):
    return _gaps(t).select("event_id", "trip_id", "at", "next_at", "gap_s", F.round("distance_m", 3).alias("distance_m"))


@query("win07_freeze_runs", "select * from v_freezes")
def _(t):
    return qu.freeze_runs(_fixes(t), tie="event_id").drop("run")


_IN = "lat between -37.815 and -37.808 and lon between 144.962 and 144.975"
_NIN = "next_lat between -37.815 and -37.808 and next_lon between 144.962 and 144.975"


@query("agg32_loop_gap_share", f"""
select cast(h as integer) as threshold_s, count(*) as total_gaps, count(*) filter ({_IN} and {_NIN}) as contained,
 count(*) filter (not ({_IN}) and {_NIN}) as entry, count(*) filter ({_IN} and not ({_NIN})) as exit,
 count(*) filter (not ({_IN}) and not ({_NIN})) as outside,
 round(100.0::double * count(*) filter ({_IN} and {_NIN}) / count(*), 6) as contained_pct
from v_gaps, (values (60), (90), (43200)) as x(h) where gap_s >= h group by h""")
def _(t):
    return qu.loop_gap_share(_gaps(t), (60, 90, 43200)).withColumn("contained_pct", F.round("contained_pct", 6))


@query("agg33_city_loop_summary", f"""
with m as (select 'freeze' as kind, duration_s::double as v from v_freezes
 union all select 'disappearance', gap_s::double from v_gaps where {_IN} and gap_s > 30
 union all select 'teleport', distance_m from v_gaps where {_IN} and gap_s > 30 and distance_m > 300)
select kind, count(*) as n, round(max(v), 3) as max, round(quantile_cont(v, 0.5), 3) as p50 from m group by kind
union all select 'trips_through', count(distinct trip_id), null, null from v_positions where {_IN}""")
def _(t):
    return qu.city_loop_summary(_fixes(t), tie="event_id").withColumns({"max": F.round("max", 3), "p50": F.round("p50", 3)})


@query("scl10_haversine", """
select trip_id, round(sum(distance_m), 2) as travelled_m, round(max(distance_m), 3) as longest_m from v_gaps group by trip_id""")
def _(t):
    return _gaps(t).groupBy("trip_id").agg(F.round(F.sum("distance_m"), 2).alias("travelled_m"),
                                           F.round(F.max("distance_m"), 3).alias("longest_m"))


@query("scl11_box_containment", f"select trip_id, count(*) filter ({_IN}) as inside, count(*) as fixes from v_positions group by 1")
def _(t):
    return t.positions.groupBy("trip_id").agg(
        F.count_if(geo.in_box(F.col("lat"), F.col("lon"))).alias("inside"), F.count(F.lit(1)).alias("fixes"))


@query("scl12_loop_containment", f"""
select trip_id, count(*) filter ({_IN} and {_NIN}) as contained, count(*) as gaps from v_gaps group by 1""")
def _(t):
    inside = geo.loop_contained(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"))
    return _gaps(t).groupBy("trip_id").agg(F.count_if(inside).alias("contained"), F.count(F.lit(1)).alias("gaps"))


_BAND = f"""case when {_HOUR} < 7 then 'overnight' when {_HOUR} < 9 then 'am_peak' when {_HOUR} < 16 then 'midday'
 when {_HOUR} < 18 then 'pm_peak' else 'evening' end"""


@query("scl07_time_band", f"select {_BAND} as band, count(*) as n from (select ts_us // 1000000 as at from v_events) group by 1")
def _(t):
    band = gt.time_band(gt.local_hour(F.timestamp_seconds("at")))
    return _polls(t).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("flt08_overnight", f"select {_HOUR} < 7 as overnight, count(*) as n from (select ts_us // 1000000 as at from v_events) group by 1")
def _(t):
    return _polls(t).groupBy(gt.is_overnight(F.timestamp_seconds("at")).alias("overnight")).agg(F.count(F.lit(1)).alias("n"))


def _live(t: Tables):
    hour = (F.floor(F.col("ts_us") / 3_600_000_000) * 3600 - SHIFT_S).cast("bigint")
    return t.positions.select(hour.alias("at"), "trip_id").distinct()


def _samples(t: Tables):
    return qu.sample_grid(_live(t))


def _schedule(t: Tables):
    return qu.trip_spans(t.stop_times), t.trips, sc.active_services(t.calendar, t.calendar_dates)


def _coverage(t: Tables):
    return qu.coverage_samples(_samples(t), _live(t), *_schedule(t), tolerance_s=1500)


@query("join14_scheduled_running", "select sample_at, count(*) as scheduled, min(trip_id) as first_trip from v_running group by 1")
def _(t):
    return qu.scheduled_running(_samples(t), *_schedule(t))


_NEAREST = """
select sample_at, arg_min(at, (abs(at - sample_at), at)) as poll_at
from v_samples join (select distinct at from v_live) on abs(at - sample_at) <= 1500 group by sample_at"""


@query("join15_nearest_poll", _NEAREST)
def _(t):
    return qu.nearest_poll(_samples(t), _live(t), tolerance_s=1500)


_COVERAGE = f"""
select sample_at, count(*) as scheduled, count(v.trip_id) as live, 100.0::double * count(v.trip_id) / count(*) as pct
from v_running r join ({_NEAREST}) n using (sample_at)
left join v_live v on v.at = n.poll_at and v.trip_id = r.trip_id group by sample_at"""


@query("join16_coverage", f"select sample_at, scheduled, live, round(pct, 6) as coverage_pct from ({_COVERAGE})")
def _(t):
    return _coverage(t).select("sample_at", "scheduled", "live", F.round("coverage_pct", 6).alias("coverage_pct"))


@query("agg17_coverage_by_band", f"""
select {_BAND} as band, count(*) as samples, round(avg(pct), 6) as mean_pct, round(min(pct), 6) as min_pct,
 round(quantile_cont(pct, 0.1), 6) as p10_pct from (select sample_at as at, pct from ({_COVERAGE})) group by 1""")
def _(t):
    c = qu.coverage_by_band(_coverage(t))
    return c.withColumns({x: F.round(x, 6) for x in ("mean_pct", "min_pct", "p10_pct")})


@query("join17_poll_proximity", """
with v as (select distinct ts_us // 1000000 as at from v_polls where feed = 'vehicle_positions'),
 u as (select distinct ts_us // 1000000 as at from v_polls where feed = 'trip_updates'),
 n as (select v.at, exists (select 1 from u where abs(u.at - v.at) <= 150) as near from v)
select count(*) as vp_polls, count(*) filter (near) as near_polls,
 round(100.0::double * count(*) filter (near) / count(*), 6) as near_pct from n""")
def _(t):
    polls = _polls(t)
    vp, tu = (polls.filter(F.col("feed") == f) for f in ("vehicle_positions", "trip_updates"))
    return qu.poll_proximity(vp, tu, within_s=150).withColumn("near_pct", F.round("near_pct", 6))


_RT = """
select trip_id, arg_max(rel, (src, ts_us, event_id)) as relationship from (
 select trip_id, 'SCHEDULED' as rel, 0 as src, ts_us, event_id from v_positions
 union all select trip_id, relationship, 1, ts_us, event_id from v_trip_updates) group by trip_id"""


def _last_relationships(t: Tables):
    vp = t.positions.withColumn("relationship", F.lit(None).cast("string"))
    return qu.last_relationships(vp, t.trip_updates, ["ts_us", "event_id"])


def _known(t: Tables):
    """Static trips that run on the request day."""
    return sc.trips_on(t.trips, sc.active_services(t.calendar, t.calendar_dates, sc.one_day(
        t.spark, gt.service_date_of(FEED_NOW.replace(year=1998, month=6, day=15)))))


@query("join18_join_rate", f"""
with r as (select r.*, r.trip_id in (select trip_id from v_trips_today) as m from ({_RT}) r)
select count(*) filter (relationship = 'SCHEDULED') as total_scheduled,
 count(*) filter (relationship = 'SCHEDULED' and m) as matched_scheduled, count(*) as total_all,
 count(*) filter (m) as matched_all,
 round(100.0::double * count(*) filter (relationship = 'SCHEDULED' and m) / count(*) filter (relationship = 'SCHEDULED'), 6)
  as join_pct_scheduled_only, round(100.0::double * count(*) filter (m) / count(*), 6) as join_pct_all from r""")
def _(t):
    rate = qu.join_rate(_last_relationships(t), _known(t))
    return rate.withColumns({c: F.round(c, 6) for c in ("join_pct_scheduled_only", "join_pct_all")})


@query("join19_integrity", f"""
select relationship, count(*) as seen, count(*) filter (m) as matched, count(*) filter (not m) as unmatched
from (select r.*, r.trip_id in (select trip_id from v_trips_today) as m from ({_RT}) r) group by relationship""")
def _(t):
    return qu.integrity_by_relationship(_last_relationships(t), _known(t))


_STEPS = """
with c as (select cycle, trip_id, route_id, delay, round(lat, 6) as lat from v_merged),
 o as (select cycle, lag(cycle) over (order by cycle) as before from (select distinct cycle from c)),
 b as (select c.* from c join o using (cycle) where before is not null),
 a as (select o.cycle, c.trip_id, c.route_id, c.delay, c.lat from c join o on c.cycle = o.before)"""


@query("set02_snapshot_diff", f"""{_STEPS}
select 'changed' as change, b.cycle, b.trip_id from b left join a on a.cycle = b.cycle and a.trip_id = b.trip_id where a.trip_id is null
 or a.route_id is distinct from b.route_id or a.delay is distinct from b.delay or a.lat is distinct from b.lat
union all select 'removed', a.cycle, a.trip_id from a where not exists (select 1 from b where b.cycle = a.cycle and b.trip_id = a.trip_id)""")
def _(t):
    changed, removed = fd.snapshot_diff(*_steps(t), key=("cycle", "trip_id"))
    return changed.select(F.lit("changed").alias("change"), "cycle", "trip_id").unionByName(
        removed.select(F.lit("removed").alias("change"), "cycle", "trip_id"))


def _steps(t: Tables):
    """Every cycle's rows against those of the cycle before."""
    return fd.with_previous_cycle(merged(t).select("cycle", "trip_id", "route_id", "delay", F.round("lat", 6).alias("lat")))


@query("set03_apply_delta", f"{_STEPS} select * from b")
def _(t):
    before, after = _steps(t)
    return fd.apply_delta(before, *fd.snapshot_diff(before, after, key=("cycle", "trip_id")), key=("cycle", "trip_id"))


# --- alerts ---

@query("flt01_active_alerts", "select id from v_active_alerts")
def _(t):
    return t.alert_rows.filter(al.is_active(_now())).select("id")


@query("flt03_briefable_alerts", "select id, route_id from v_active_alerts where not no_entity and route_id is not null")
def _(t):
    return al.briefable(t.alert_rows, _now()).select("id", F.get("informed_entities", 0)["route_id"].alias("route_id"))


@query("flt03_has_briefable", "select count(*) > 0 as has_briefable from v_active_alerts where not no_entity and route_id is not null")
def _(t):
    return al.has_briefable(t.alert_rows, _now())


@query("join11_alert_match", """
with r as (select trip_id as request_id, route_id, stop_id, cast(user_id % 2 as integer) as direction_id
  from v_latest_stus where idx = 0)
select request_id, count(*) as alerts, cast(sum(pos) as bigint) as pos_sum from r, v_active_alerts a
where a.no_entity or ((a.route_id is null or r.route_id is null or a.route_id = r.route_id)
 and (a.stop_id is null or a.stop_id = r.stop_id) and (a.direction_id is null or a.direction_id = r.direction_id))
group by request_id""")
def _(t):
    requests = t.latest_snapshots.select(
        F.col("trip_id").alias("request_id"), "route_id", F.get("stop_time_updates", 0)["stop_id"].alias("stop_id"),
        (F.col("trip_id").cast("bigint") % 2).cast("int").alias("direction_id"))
    # alerts of the same entities and requests for the same are each matched as one: pairs grow with what is named, not with the rows
    value = F.col("id").cast("bigint")
    groups = checkpointed(al.alike(t.alert_rows, _now(), value))
    kinds = checkpointed(requests.select(*al.AXES).distinct().withColumn("request_id", al.asked()))
    pairs, classes = al.match_by_shape(groups, kinds, _now())
    totals = groups.select("id", "n", "s")
    own = pairs.join(totals, "id").groupBy(F.col("request_id").alias("asked")).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    # one row per shape of requests, eight at most
    common = classes.join(totals, "id").groupBy("shape").agg(F.sum("n").alias("_cn"), F.sum("s").alias("_cs"))
    zero = F.lit(0).cast("bigint")
    counted = requests.select("request_id", al.asked().alias("asked"), al.shape_of().alias("shape")).join(
        F.broadcast(common), "shape", "left").join(own, "asked", "left")
    return counted.select(
        "request_id", (F.coalesce("_n", zero) + F.coalesce("_cn", zero)).alias("alerts"), (F.coalesce("_s", zero) + F.coalesce("_cs", zero)).alias("pos_sum"),
    ).filter("alerts > 0")


@query("join12_alerts_for_line", """
select id, case when no_entity or route_id is null or route_id = 'R1-R:' then 'R1-R:' else 'R1:' end as matched_route_id
from v_active_alerts where no_entity or route_id is null or route_id in ('R1:', 'R1-R:')""")
def _(t):
    # the base id sorts after its replacement, so wildcard matches are first found under that
    return al.alerts_for_line(t.alert_rows, t.routes, "NATION_1", _now()).select("id", "matched_route_id")


def _inferred(t: Tables):
    return sc.likely_lines(t.alert_stops, t.stop_home_lines, t.routes)


_VOTES = """
with n as (select distinct stop_id, long_name from v_home_lines join v_routes using (route_id)),
 v as (select alert_id, long_name, count(*) as votes from v_alert_stops join n using (stop_id) group by all),
 s as (select alert_id, count(*) as listed from v_alert_stops group by all),
 r as (select *, lead(votes) over w as runner from v
  window w as (partition by alert_id order by votes desc, long_name) qualify row_number() over w = 1)
select alert_id, long_name from r join s using (alert_id) where votes * 2 > listed and votes > coalesce(runner, 0)"""


@query("join13_alert_route_names", f"""
select a.id, a.route_id, a.stop_id, case when a.route_id is not null then r.long_name
 when a.stop_id is not null then i.long_name end as route_name
from v_alerts a left join v_routes r on r.route_id = a.route_id left join ({_VOTES}) i on i.alert_id = a.id
where not a.no_entity""")
def _(t):
    return al.name_entities(t.alert_rows, t.routes, _inferred(t)).select("id", "route_id", "stop_id", "route_name")


@query("prj18_alert_display_fields", f"""
select a.id, case when not no_period then cast(epoch(start_at) as bigint) end as since,
 coalesce(case when no_entity then null when a.route_id is not null then r.long_name
  when a.stop_id is not null then i.long_name end, '') as line_names
from v_alerts a left join v_routes r on r.route_id = a.route_id left join ({_VOTES}) i on i.alert_id = a.id""")
def _(t):
    named = al.name_entities(t.alert_rows, t.routes, _inferred(t))
    return al.display_fields(named, t.alert_rows).select(
        "id", epoch("since").alias("since"), F.array_join("line_names", ",").alias("line_names"))


@query("sort01_alerts_newest_first", """
select id, row_number() over (order by case when not no_period then start_at end desc nulls last, pos) as place
from v_active_alerts""")
def _(t):
    from signalbox.operators.ordered import global_rank
    active = t.alert_rows.filter(al.is_active(_now())).select(
        "id", "pos", F.coalesce(-epoch(al.earliest_start()), F.lit(0).cast("bigint")).alias("age"))
    return global_rank(active, ["age", "pos"], "place").select("id", "place")


@query("str11_latest_alert_poll", f"""
select id, effect from ({_ALERTS}) where cast(id as bigint) <= 1000000
 and cast(id as bigint) = (select max(p_partkey) from part)""")
def _(t):
    parsed = _parsed_alerts(t)
    polls = fd.with_cycle(t.alert_captures).select("cycle_at")
    return al.latest_alerts(parsed, polls, _now()).select("id", "effect")
