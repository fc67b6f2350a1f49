"""Queries over the static timetable: calendar, pins, departures, patterns, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbox.functions import gtfstime as gt
from signalbox.functions import punctuality as pu
from signalbox.operators import schedule as sc
from signalbox.plans.canonical import SCHEDULE_NOW, Tables, epoch, ts
from signalbox.plans.registry import query

DAY = gt.service_date_of(SCHEDULE_NOW)
NEXT_DAY = DAY.replace(day=DAY.day + 1)


def _active(t: Tables, day=DAY):
    return sc.active_services(t.calendar, t.calendar_dates, sc.one_day(t.spark, day))


def _today(t: Tables):
    return sc.trips_on(t.trips, _active(t))


def _departures(t: Tables):
    return sc.scheduled_departures(t.stop_times, _today(t), t.stops, DAY, ts(SCHEDULE_NOW))


def _out(df):
    return df.withColumn("scheduled_s", epoch("scheduled_at")).drop("scheduled_at")


@query("join03_active_services", """
select strftime(service_date, '%Y-%m-%d') as service_date, service_id from v_service_days""")
def _(t):
    days = t.trips.select(F.col("start_date").alias("service_date")).distinct()
    return sc.active_services(t.calendar, t.calendar_dates, days).select(
        F.col("service_date").cast("string").alias("service_date"), "service_id")


@query("join04_trips_on_date", "select trip_id, route_id, service_id from v_trips_today")
def _(t):
    return _today(t).select("trip_id", "route_id", "service_id")


@query("agg01_trip_terminus", """
select trip_id, stop_id as terminus_stop_id, coalesce(arrival_time, departure_time) as terminus_time,
 stop_sequence as terminus_sequence from v_stop_times
qualify row_number() over (partition by trip_id order by stop_sequence desc) = 1""")
def _(t):
    return sc.trip_termini(t.stop_times)


@query("agg02_trip_span", """
select trip_id, min(arr_s) as start_s, max(dep_s) as end_s from v_stop_times group by trip_id""")
def _(t):
    from signalbox.operators.quality import trip_spans
    return trip_spans(t.stop_times)


def _requests(t: Tables):
    return t.trips.select("trip_id", F.col("start_date").alias("service_date"))


@query("join05_pinned_terminus", """
with m as (select * from v_stop_times qualify row_number() over (partition by trip_id order by stop_sequence desc) = 1)
select t.trip_id, strftime(t.start_date, '%Y-%m-%d') as service_date,
 case when p.digest is not null then m.stop_id end as terminus_stop_id,
 case when p.digest is not null then m.stop_sequence end as terminus_sequence,
 case when p.digest is not null then cast(epoch(timezone('Australia/Melbourne',
  cast(t.start_date as timestamp) + interval 12 hour)) as bigint) - 43200 + coalesce(m.arr_s, m.dep_s) end as scheduled_s
from v_trips t left join v_pins p on p.service_date = t.start_date and p.digest = t.digest
left join m on m.trip_id = t.trip_id""")
def _(t):
    static = t.stop_times.join(t.trips.select("trip_id", "digest"), "trip_id")
    termini = sc.trip_termini(static, ["digest", "trip_id"])
    return sc.pinned_terminus(_requests(t), t.pins, termini).select(
        "trip_id", F.col("service_date").cast("string").alias("service_date"), "terminus_stop_id", "terminus_sequence",
        epoch("scheduled_arrival").alias("scheduled_s"))


@query("prj13_trip_static_fields", """
select t.trip_id, strftime(t.start_date, '%Y-%m-%d') as service_date,
 case when p.digest is not null then nullif(headsign, '') end as headsign,
 case when p.digest is not null then direction_id end as direction_id
from v_trips t left join v_pins p on p.service_date = t.start_date""")
def _(t):
    return sc.pinned_trip_fields(_requests(t), t.pins, t.trips).withColumn(
        "service_date", F.col("service_date").cast("string"))


@query("join30_pinned_dimension", """
select trip_id, route_id, headsign from v_trips where digest in
 (select digest from v_pins where service_date = DATE '1998-06-15')""")
def _(t):
    return sc.pinned_dimension(t.trips, t.pins, DAY).select("trip_id", "route_id", "headsign")


@query("prj12_platform_station_map", """
select stop_id, parent_station as station_id from v_stops where location_type <> 1 and parent_station is not null""")
def _(t):
    return sc.platform_parents(t.stops)


@query("prj16_station_display_name", """
select stop_id, replace(name, ' Railway Station', '') as display_name from v_stops where location_type = 1""")
def _(t):
    return t.stops.filter(F.col("location_type") == 1).select(
        "stop_id", pu.station_display_name("name").alias("display_name"))


@query("prj11_replacement_route_id", """
select route_id, regexp_replace(route_id, ':+$', '')||'-R:' as replacement_id, count(*) as trips
from v_trips group by route_id""")
def _(t):
    return t.trips.groupBy("route_id").agg(F.count(F.lit(1)).alias("trips")).select(
        "route_id", pu.replacement_route_id("route_id").alias("replacement_id"), "trips")


@query("join06_stop_routes", "select stop_id, route_id from v_stop_routes")
def _(t):
    return sc.stop_routes(t.stop_times, t.trips, t.stops)


@query("join07_station_platforms", "select station_id, stop_id from v_platforms")
def _(t):
    return sc.station_platforms(t.stops)


@query("join08_departures", "select * from v_departures")
def _(t):
    return _out(_departures(t))


@query("win03_next_per_direction", "select * from v_top_departures")
def _(t):
    return _out(sc.top_per_direction(_departures(t)))


@query("win04_soonest_per_direction", """
select station_id, coalesce(cast(direction_id as varchar), headsign) as heading, trip_id, route_id, direction_id,
 headsign, scheduled_s, stop_id from v_departures qualify row_number() over
 (partition by station_id, coalesce(cast(direction_id as varchar), headsign) order by scheduled_s, trip_id, stop_id) = 1""")
def _(t):
    return _out(sc.soonest_per_direction(_departures(t)))


def _added(t: Tables):
    return sc.added_departures(t.latest_snapshots, t.stops, F.timestamp_seconds(F.lit(0)))


@query("join09_added_departures", "select * from v_added")
def _(t):
    return _out(_added(t))


@query("sort05_added_cap", """
select station_id, count(*) as shown, min(scheduled_s) as first_s, max(scheduled_s) as last_s from v_added group by 1""")
def _(t):
    return _out(_added(t)).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("shown"), F.min("scheduled_s").alias("first_s"), F.max("scheduled_s").alias("last_s"))


@query("set01_scheduled_and_added", "select * from v_top_departures union all by name select * from v_added")
def _(t):
    return _out(sc.merge_departures(sc.top_per_direction(_departures(t)), _added(t)))


@query("sort03_merged_by_time", """
select station_id, trip_id, scheduled_s, row_number() over (partition by station_id order by scheduled_s, trip_id, stop_id)
 as place from (select * from v_top_departures union all by name select * from v_added)""")
def _(t):
    from pyspark.sql import Window
    merged = _out(sc.merge_departures(sc.top_per_direction(_departures(t)), _added(t)))
    w = Window.partitionBy("station_id").orderBy("scheduled_s", "trip_id", "stop_id")
    return merged.select("station_id", "trip_id", "scheduled_s", F.row_number().over(w).cast("bigint").alias("place"))


def _overlay(t: Tables):
    return _out(sc.live_overlay(_departures(t), t.latest_snapshots, t.stops)).withColumn(
        "predicted_s", epoch("predicted_at")).drop("predicted_at").withColumn(
        "delay_seconds", F.col("delay_seconds").cast("bigint"))


@query("join10_live_overlay", "select * from v_overlay")
def _(t):
    return _overlay(t)


@query("scl21_schedule_badge", """
select badge, count(*) as n from (select case when is_cancelled then 'Cancelled' when is_added then 'Extra service'
 when not is_live then 'Scheduled' when delay_seconds is null or abs(delay_seconds) <= 60 then 'On time'
 when delay_seconds > 0 then '+'||cast(floor(delay_seconds / 60.0 + 0.5) as bigint)||' min'
 else cast(floor(delay_seconds / 60.0 + 0.5) as bigint)||' min early' end as badge
 from (select is_cancelled, is_added, is_live, delay_seconds from v_overlay
  union all select status = 'cancelled', false, status <> 'undetermined_gap', delay_seconds from v_completions))
group by badge""")
def _(t):
    board = _overlay(t).select("is_cancelled", "is_added", "is_live", F.col("delay_seconds").cast("bigint").alias("d"))
    history = t.completions.select(
        (F.col("status") == "cancelled").alias("is_cancelled"), F.lit(False).alias("is_added"),
        (F.col("status") != "undetermined_gap").alias("is_live"), F.col("delay_seconds").cast("bigint").alias("d"))
    badge = pu.schedule_badge(F.col("is_cancelled"), F.col("is_added"), F.col("is_live"), F.col("d"))
    return board.unionByName(history).groupBy(badge.alias("badge")).agg(F.count(F.lit(1)).alias("n"))


_NO_SERVICE = """
select distinct p.station_id, r.route_id, r.short_name, r.long_name from v_platforms p
join v_stop_routes s on s.stop_id = p.stop_id join v_routes r on r.route_id = s.route_id
where r.route_id not in (select route_id from v_trips_idle)"""


@query("join21_no_service_today", _NO_SERVICE.replace("v_trips_idle", """(select route_id from v_trips_today
 where route_id not in ('R3:', 'R7:', 'R11:'))"""))
def _(t):
    # three lines are treated as suspended, since every line of the driver data runs daily
    today = _today(t).filter(~F.col("route_id").isin("R3:", "R7:", "R11:"))
    return sc.lines_without_service(sc.stop_routes(t.stop_times, t.trips, t.stops), t.stops, t.routes, today)


@query("flt06_line_lookup", """
select 'exact' as tier, route_id, short_name from v_routes where lower(short_name) = 'nation_1'
union all select 'substring', route_id, short_name from v_routes
 where contains(lower(short_name), 'ation_1') and short_name <> 'Replacement Bus'""")
def _(t):
    pick = lambda name, tier: sc.routes_by_name(t.routes, name).select(
        F.lit(tier).alias("tier"), "route_id", "short_name")
    return pick(" NATION_1 ", "exact").unionByName(pick("ation_1", "substring"))


@query("agg13_likely_line", """
with n as (select distinct stop_id, long_name from v_home_lines join v_routes using (route_id)),
 v as (select alert_id, long_name, count(*) as votes from v_alert_stops join n using (stop_id) group by all),
 s as (select alert_id, count(*) as listed from v_alert_stops group by all),
 r as (select *, lead(votes) over w as runner from v
  window w as (partition by alert_id order by votes desc, long_name) qualify row_number() over w = 1)
select alert_id, long_name, votes, listed from r join s using (alert_id)
where votes * 2 > listed and votes > coalesce(runner, 0)""")
def _(t):
    return sc.likely_lines(t.alert_stops, t.stop_home_lines, t.routes)


_SKIP = """
with p as (select s.trip_id, list(s.stop_id order by s.stop_sequence) as stops,
  bool_or(coalesce(st.parent_station in ('P3', 'P7', 'P11'), false)) as via
 from v_stop_times s left join v_stops st on st.stop_id = s.stop_id group by s.trip_id),
 k as (select p.*, t.route_id, t.direction_id, stops[1] as a, stops[-1] as z from p join v_trips t using (trip_id)
  left join v_routes r on r.route_id = t.route_id where coalesce(r.short_name <> 'Replacement Bus', true)),
 c as (select route_id, direction_id, via, a, z, stops, count(*) as n, min(trip_id) as sample from k group by all),
 m as (select *, sum(n) over (partition by route_id, direction_id, via, a, z) as total from c
  qualify row_number() over (partition by route_id, direction_id, via, a, z order by n desc, sample) = 1)
select k.trip_id, case when m.total >= 2 then
 cast(len(list_filter(list_distinct(m.stops), lambda x: not list_contains(k.stops, x))) as bigint) end as skipped_stop_count
from k join m using (route_id, direction_id, via, a, z)"""


@query("agg14_skip_stop_counts", _SKIP)
def _(t):
    return sc.skip_stop_counts(t.trips, t.stop_times, t.stops, t.routes, loop_stations=("P3", "P7", "P11"))


@query("agg14_skip_stop_summary", f"""
select route_id, skipped_stop_count, count(*) as trips from ({_SKIP}) join v_trips using (trip_id) group by all""")
def _(t):
    counts = sc.skip_stop_counts(t.trips, t.stop_times, t.stops, t.routes, loop_stations=("P3", "P7", "P11"))
    return counts.join(t.trips.select("trip_id", "route_id"), "trip_id").groupBy("route_id", "skipped_stop_count").agg(
        F.count(F.lit(1)).alias("trips"))


@query("agg22_trip_churn", """
with o as (select trip_id from v_trips_today), n as (select trip_id from v_trips where service_id in
  (select service_id from v_service_days where service_date = DATE '1998-06-16')),
 c as (select (select count(*) from o) as total_old, (select count(*) from n) as total_new,
  (select count(*) from o join n using (trip_id)) as stable)
select *, total_old - stable as churned_from_old, round(100.0::double * stable / total_old, 6) as stable_pct from c""")
def _(t):
    tomorrow = sc.trips_on(t.trips, _active(t, NEXT_DAY))
    return sc.trip_id_churn(_today(t), tomorrow).withColumn("stable_pct", F.round("stable_pct", 6))


@query("agg23_representative_trip", "select * from v_rep_trips")
def _(t):
    return sc.representative_trips(t.trips, t.stop_times)


def _stations(t: Tables):
    return sc.route_stations(sc.representative_trips(t.trips, t.stop_times), t.stop_times, t.stops)


@query("win12_collapsed_stations", """
select * replace (round(lat, 6) as lat, round(lon, 6) as lon) from v_route_stations""")
def _(t):
    return _stations(t).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("src07_needed_shapes", """
select shape_id, count(*) as points from v_shapes where shape_id in (select shape_id from v_rep_trips) group by 1""")
def _(t):
    needed = sc.needed_shapes(t.shapes, sc.representative_trips(t.trips, t.stop_times))
    return needed.groupBy("shape_id").agg(F.count(F.lit(1)).alias("points"))


@query("agg24_route_geometry", """
with d as (select route_id, shape_pt_sequence as position, lon, lat, false as is_fallback
 from v_rep_trips join v_shapes using (shape_id))
select route_id, position, round(lon, 6) as lon, round(lat, 6) as lat, is_fallback from (select * from d union all
 select route_id, stop_sequence, lon, lat, true from v_route_stations
 where not is_dangling and route_id not in (select route_id from d))""")
def _(t):
    reps = sc.representative_trips(t.trips, t.stop_times)
    lines = sc.route_lines(reps, sc.route_stations(reps, t.stop_times, t.stops), sc.needed_shapes(t.shapes, reps))
    return lines.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("agg25_map_bounds", """
with u as (select distinct station_id, lat, lon from v_route_stations where not is_dangling)
select round(min(lon) - 5.0 / (111.0 * cos(radians(avg(lat)))), 6) as west,
 round(max(lon) + 5.0 / (111.0 * cos(radians(avg(lat)))), 6) as east,
 round(min(lat) - 5.0 / 111.0, 6) as south, round(max(lat) + 5.0 / 111.0, 6) as north from u""")
def _(t):
    b = sc.map_bounds(_stations(t))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query("agg26_routes_by_station", """
select station_id, list_aggregate(list_sort(list(distinct route_id)), 'string_agg', ',') as routes
from v_route_stations group by station_id""")
def _(t):
    return sc.routes_by_station(_stations(t)).withColumn("routes", F.array_join("routes", ","))


@query("scl01_gtfs_seconds", """
select stop_id, count(*) as n, cast(sum(arr_s) as bigint) as arrivals, cast(sum(dep_s) as bigint) as departures,
 count(*) filter (arr_s >= 86400) as after_midnight from v_stop_times group by stop_id""")
def _(t):
    arr, dep = gt.gtfs_seconds("arrival_time"), gt.gtfs_seconds("departure_time")
    return t.stop_times.select("stop_id", arr.alias("a"), dep.alias("d")).groupBy("stop_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("arrivals"), F.sum("d").alias("departures"),
        F.count_if(F.col("a") >= 86400).alias("after_midnight"))


_DAYS = "select distinct start_date as d from v_trips"


@query("scl02_service_day_start", f"""
select strftime(d, '%Y-%m-%d') as service_date,
 cast(epoch(timezone('Australia/Melbourne', cast(d as timestamp) + interval 12 hour)) as bigint) - 43200 as start_s
from ({_DAYS})""")
def _(t):
    days = t.trips.select("start_date").distinct()
    return days.select(F.col("start_date").cast("string").alias("service_date"),
                       epoch(gt.service_day_start("start_date")).alias("start_s"))


@query("scl05_service_day_boundary", f"""
select strftime(d, '%Y-%m-%d') as service_date,
 cast(epoch(timezone('Australia/Melbourne', cast(d as timestamp) + interval 3 hour)) as bigint) as boundary_s
from ({_DAYS})""")
def _(t):
    days = t.trips.select("start_date").distinct()
    return days.select(F.col("start_date").cast("string").alias("service_date"),
                       epoch(gt.service_date_boundary("start_date")).alias("boundary_s"))


@query("scl03_scheduled_instants", """
select t.route_id, count(*) as n, min(x) as first_s, max(x) as last_s, cast(sum(x) as bigint) as total_s from
 (select trip_id, route_id, cast(epoch(timezone('Australia/Melbourne', cast(start_date as timestamp) + interval 12 hour))
   as bigint) - 43200 + arr_s as x from v_stop_times join v_trips using (trip_id)) t group by 1""")
def _(t):
    at = epoch(gt.scheduled_instant_of("start_date", "arrival_time"))
    joined = t.stop_times.join(t.trips.select("trip_id", "route_id", "start_date"), "trip_id")
    return joined.select("route_id", at.alias("x")).groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("first_s"), F.max("x").alias("last_s"),
        F.sum("x").alias("total_s"))
