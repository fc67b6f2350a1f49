"""Queries over train state: lifecycle, completion, observations, headway, model, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbox.operators import alerts as al
from signalbox.operators import completion as co
from signalbox.operators import headway as hw
from signalbox.operators import lifecycle as lc
from signalbox.operators import model as md
from signalbox.operators import observe as ob
from signalbox.operators import quality as qu
from signalbox.operators import schedule as sc
from signalbox.operators import station as st
from signalbox.operators import views as vw
from signalbox.plans.canonical import FEED_NOW, Tables, epoch, ts
from signalbox.plans.feed_queries import merged
from signalbox.plans.registry import query
from signalbox.plans.schedule_queries import _SKIP, _departures, _today
from signalbox.session import checkpointed

CYCLE_S = 21_600
COAST, EVICT = 21_600, 172_800  # events of one trip are hours apart, so thresholds scale with them


# --- station state of every snapshot ---

_ANCHORS = """
with a as (select event_id, now_s, lat, lon, idx, stop_id, stop_sequence, coalesce(arr_time, dep_time) as arr,
  coalesce(dep_time, arr_time) as dep, arr_time is not null as had_arr, dep_time is not null as had_dep,
  arr_delay, dep_delay from v_snap_stus where arr_time is not null or dep_time is not null),
 p as (select *, lead(arr) over w as n_arr, lead(stop_id) over w as n_stop, row_number() over w as rn,
  count(*) over (partition by event_id) as n from a window w as (partition by event_id order by idx)),
 h as (select event_id, now_s, lat, lon, max(n) as n, max(arr) filter (rn = 1) as a0, bool_or(had_arr) filter (rn = 1) as ha0,
  max(stop_id) filter (rn = 1) as s0, max(stop_sequence) filter (rn = 1) as q0,
  max(dep) filter (rn = n) as d1, bool_or(had_dep) filter (rn = n) as hd1,
  max(stop_id) filter (rn = n) as s1, max(stop_sequence) filter (rn = n) as q1,
  min(rn) filter (n_arr is not null and ((arr <= now_s and now_s <= dep) or (dep <= now_s and now_s < n_arr))) as k
  from p group by all),
 s as (select h.*, p.arr, p.dep, p.n_arr, p.stop_id as c_stop, p.n_stop, p.stop_sequence as c_seq,
  (p.arr <= h.now_s and h.now_s <= p.dep) as dwell
  from h left join p on p.event_id = h.event_id and p.rn = h.k),
 z as (select *, case when now_s < a0 and not ha0 then 'at' when now_s < a0 then 'between'
   when now_s >= d1 and not hd1 then 'at' when now_s >= d1 then 'between'
   when dwell then 'at' when k is not null then 'between' else 'unknown' end as status,
  case when now_s < a0 then case when not ha0 then s0 end when now_s >= d1 then case when not hd1 then s1 end
   when dwell then c_stop end as at_stop_id,
  case when now_s < a0 then null when now_s >= d1 then case when hd1 then s1 end when not dwell then c_stop end as from_stop_id,
  case when now_s < a0 then case when ha0 then s0 end when now_s >= d1 then null when not dwell then n_stop end as to_stop_id,
  case when now_s >= a0 and now_s < d1 and not dwell then
   case when n_arr - dep <= 0 then 0.0::double else least(1.0, greatest(0.0, (now_s - dep)::double / (n_arr - dep))) end end as progress,
  case when now_s < a0 then s0 when now_s < d1 then n_stop end as next_stop_id,
  case when now_s < a0 then q0 - 1 when now_s >= d1 then q1 else c_seq end as progress_sequence from s)
"""
_ALL = "from (select event_id, now_s, lat, lon, trip_id, route_id, user_id from v_snaps) e left join z using (event_id)"


def _states(t: Tables):
    now = epoch("now_at")
    return t.snapshots.withColumn("state", st.station_state(F.col("stop_time_updates"), now)).withColumn("now_s", now)


@query("scl13_station_state", f"""
{_ANCHORS} select event_id, coalesce(status, 'unknown') as status, at_stop_id, from_stop_id, to_stop_id,
 round(progress, 6) as progress {_ALL}""")
def _(t):
    return _states(t).select("event_id", "state.status", "state.at_stop_id", "state.from_stop_id", "state.to_stop_id",
                             F.round("state.progress", 6).alias("progress"))


@query("prj09_stop_anchors", """
select event_id, count(*) as anchors, cast(sum(coalesce(arr_time, dep_time)) as bigint) as arr_sum,
 cast(sum(coalesce(dep_time, arr_time)) as bigint) as dep_sum, count(arr_time) as real_arrivals
from v_snap_stus where arr_time is not null or dep_time is not null group by event_id""")
def _(t):
    a = t.snapshots.select("event_id", F.explode(st.anchors(F.col("stop_time_updates"))).alias("a"))
    return a.groupBy("event_id").agg(F.count(F.lit(1)).alias("anchors"), F.sum("a.arr").alias("arr_sum"),
                                     F.sum("a.dep").alias("dep_sum"), F.count_if("a.had_arr").alias("real_arrivals"))


@query("scl14_next_stop", f"""
{_ANCHORS} select e.event_id, z.next_stop_id, cast(coalesce(u.arr_delay, u.dep_delay) as bigint) as next_stop_delay
from v_snaps e left join z using (event_id)
left join v_snap_stus u on u.event_id = e.event_id and u.stop_id = z.next_stop_id""")
def _(t):
    found = t.snapshots.select("event_id", st.next_stop(F.col("stop_time_updates"), epoch("now_at")).alias("n"))
    return found.select("event_id", "n.next_stop_id", F.col("n.next_stop_delay").cast("bigint").alias("next_stop_delay"))


@query("scl15_progress_sequence", f"{_ANCHORS} select event_id, progress_sequence {_ALL}")
def _(t):
    return t.snapshots.select("event_id", st.progress_sequence(F.col("stop_time_updates"), epoch("now_at"))
                              .alias("progress_sequence"))


@query("join22_geofence", f"""
{_ANCHORS}, d as (select e.event_id, coalesce(z.status, 'unknown') as status, e.lat, e.lon,
  coalesce(at_stop_id, from_stop_id) as p, to_stop_id as q {_ALL})
select d.event_id, case when status <> 'unknown' then
 coalesce(2*6371000.0*asin(sqrt(pow(sin(radians(a.lat-d.lat)/2),2)+cos(radians(d.lat))*cos(radians(a.lat))*pow(sin(radians(a.lon-d.lon)/2),2))) <= 300, false)
 or coalesce(2*6371000.0*asin(sqrt(pow(sin(radians(b.lat-d.lat)/2),2)+cos(radians(d.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-d.lon)/2),2))) <= 300, false)
 end as geofence_confirmed
from d left join v_stops a on a.stop_id = d.p left join v_stops b on b.stop_id = d.q""")
def _(t):
    return st.geofence(_states(t), t.stops, radius_m=300).select("event_id", "geofence_confirmed")


def _dist(a, b):
    return (f"2*6371000.0*asin(sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))"
            f"*pow(sin(radians({b}.lon-{a}.lon)/2),2)))")


@query("join23_nearby_trains", f"""
select s.stop_id as station_id, count(*) as trains, round(min({_dist('s', 'p')}), 3) as nearest_m
from v_stops s, v_positions p where s.location_type = 1 and {_dist('s', 'p')} <= 500 group by 1""")
def _(t):
    stations = t.stops.filter(F.col("location_type") == 1).select(F.col("stop_id").alias("station_id"), "lat", "lon")
    near = st.nearby_trains(t.positions.select("event_id", "lat", "lon"), stations)
    return near.groupBy("station_id").agg(F.count(F.lit(1)).alias("trains"), F.round(F.min("distance_m"), 3).alias("nearest_m"))


# --- lifecycle ---


def _touches(t: Tables):
    return merged(t).select("trip_id", (F.col("cycle") * CYCLE_S).alias("at"), F.col("in_vp").alias("has_position"), "lat", "lon")


def _cycles(t: Tables):
    at = (F.floor(F.col("ts_us") / (CYCLE_S * 1_000_000)) * CYCLE_S).cast("bigint")
    return t.polls.groupBy(at.alias("at")).agg((F.count_if(~F.col("ok")) * 100 > 24 * F.count(F.lit(1))).alias("backoff"))


_LINE = f"""
with cy as (select ts_us // 21600000000 * {CYCLE_S} as c, count(*) filter (not ok) * 100 > 24 * count(*) as backoff
  from v_polls group by 1),
 ln as (select c, backoff, lag(c) over (order by c) as prev_c,
  sum(case when backoff then 0 else d end) over (order by c) as a,
  sum(case when backoff then 1 else 0 end) over (order by c) as b
  from (select *, coalesce(c - lag(c) over (order by c), 0) as d from cy)),
 tc as (select trip_id, cycle * {CYCLE_S} as c, in_vp as pos, lat, lon from v_merged),
 tg as (select tc.*, ln.a, ln.b, ln.prev_c, lag(tc.c) over (partition by trip_id order by tc.c) as prev_t from tc join ln using (c)),
 sg as (select *, sum(case when prev_t is null or prev_c - prev_t >= {EVICT} then 1 else 0 end)
  over (partition by trip_id order by c) as seg from tg),
 fx as (select *, max(case when pos then c end) over (partition by trip_id, seg order by c rows between unbounded preceding
   and 1 preceding) as fix_c, row_number() over (partition by trip_id, seg order by c) as rn,
  lead(c) over (partition by trip_id, seg order by c) as next_t,
  lead(c) over (partition by trip_id order by c) as next_any from sg),
 ff as (select fx.*, l.a as fix_a, l.b as fix_b, pa.a as prev_a, pa.b as prev_b, f.lat as fix_lat, f.lon as fix_lon from fx
  left join ln l on l.c = fix_c left join ln pa on pa.c = fx.prev_c
  left join tc f on f.trip_id = fx.trip_id and f.c = fix_c),
 back as (select trip_id, 'reappeared' as reason, c as emitted_at, fix_c as last_seen_at, fix_lat, fix_lon, lat, lon,
   (select min(c) from ln where ln.a >= fix_a + {COAST}) as ghost_started_at,
   coalesce(prev_b - fix_b > 0, false) as backoff_overlapped
  from ff where pos and rn > 1 and (fix_c is null or prev_a - fix_a >= {COAST})),
 ends as (select ff.*, case when pos then c else fix_c end as own_c,
   (select min(l.c) from ln l where l.c >= ff.c + {EVICT}) as evict_c, (select max(c) from ln) as final_c
  from ff where next_t is null),
 closed as (select e.trip_id, case when evict_c is not null then 'timed_out' else 'flushed' end as reason,
   coalesce(evict_c, final_c) as emitted_at, own_c as last_seen_at, o.a as own_a, o.b as own_b
  from ends e left join ln o on o.c = own_c),
 gone as (select k.trip_id, k.reason, k.emitted_at, k.last_seen_at, f.lat as fix_lat, f.lon as fix_lon,
   cast(null as double) as lat, cast(null as double) as lon,
   (select min(c) from ln where ln.a >= own_a + {COAST}) as ghost_started_at,
   coalesce(l.b - own_b > 0, false) as backoff_overlapped from closed k join ln l on l.c = k.emitted_at
   left join tc f on f.trip_id = k.trip_id and f.c = k.last_seen_at
  where own_a is null or l.a - own_a >= {COAST}),
 ep as (select * from back union all select * from gone)
"""


def _episodes(t: Tables, resolutions=None):
    return lc.ghost_episodes(_touches(t), _cycles(t), resolutions, coasting_s=COAST, max_age_s=EVICT)


@query("str02_ghost_episodes", f"""
{_LINE} select trip_id, reason, emitted_at, last_seen_at, ghost_started_at,
 cast(emitted_at - ghost_started_at as double) as ghost_duration_s, backoff_overlapped,
 coalesce(fix_lat between -37.815 and -37.808 and fix_lon between 144.962 and 144.975
  and lat between -37.815 and -37.808 and lon between 144.962 and 144.975, false) as loop_contained from ep""")
def _(t):
    return _episodes(t).select("trip_id", "reason", "emitted_at", "last_seen_at", "ghost_started_at", "ghost_duration_s",
                               "backoff_overlapped", "loop_contained")


@query("str03_episode_summary", f"""
{_LINE} select reason, count(*) as n, count(ghost_started_at) as with_start,
 cast(sum(emitted_at - ghost_started_at) as double) as total_s from ep group by reason""")
def _(t):
    return _episodes(t).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count("ghost_started_at").alias("with_start"), F.sum("ghost_duration_s").alias("total_s"))


@query("str04_timed_out_trips", f"{_LINE} select trip_id, emitted_at from ep where reason = 'timed_out'")
def _(t):
    return _episodes(t).filter(F.col("reason") == "timed_out").select("trip_id", "emitted_at")


@query("str07_flushed_trips", f"{_LINE} select trip_id, emitted_at from ep where reason = 'flushed'")
def _(t):
    return _episodes(t).filter(F.col("reason") == "flushed").select("trip_id", "emitted_at")


_TRACKED = f"""{_LINE}, tr as (select e.trip_id,
  case when own_c = final_c then 'live' when own_c is null then 'ghost' when l.a - o.a >= {COAST} then 'ghost'
   else 'coasting' end as status, own_c as last_seen_at, e.c as last_touched_at, l.a as now_a, o.a as own_a
  from ends e left join ln o on o.c = own_c join ln l on l.c = final_c where next_any is null and final_c - e.c < {EVICT})"""


def _tracked(t: Tables):
    return lc.tracked_trips(_touches(t), _cycles(t), coasting_s=COAST, max_age_s=EVICT)


@query("str02_tracked_trips", f"""
{_TRACKED} select trip_id, status, last_seen_at, last_touched_at,
 case when status = 'ghost' then (select min(c) from ln where ln.a >= own_a + {COAST}) end as ghost_started_at from tr""")
def _(t):
    return _tracked(t).select("trip_id", "status", "last_seen_at", "last_touched_at", "ghost_started_at")


@query("agg27_status_counts", f"""
{_TRACKED} select s as status, count(trip_id) as n from (values ('live'), ('coasting'), ('ghost')) x(s)
left join tr on status = s group by s""")
def _(t):
    return lc.status_counts(_tracked(t))


@query("win13_ghost_duration_so_far", f"""
{_TRACKED} select trip_id, cast(1706745600 - (select min(c) from ln where ln.a >= own_a + {COAST}) as double) as ghost_s
from tr where status = 'ghost'""")
def _(t):
    return _tracked(t).filter(F.col("status") == "ghost").select(
        "trip_id", lc.ghost_duration_so_far(F.lit(1706745600)).alias("ghost_s"))


@query("flt05_current_trains", f"{_TRACKED} select trip_id from tr where 1706659200 - last_touched_at <= 86400")
def _(t):
    return _tracked(t).filter(lc.is_current(F.lit(1706659200), 86400)).select("trip_id")


# --- completion ---


def _update_rows(t: Tables):
    """Snapshots as trip-update rows, each trip on the service day of its static order."""
    day = t.trips.select("trip_id", F.date_format("start_date", "yyyyMMdd").alias("static_date"))
    return t.snapshots.join(day, "trip_id").select(
        "trip_id", (F.floor(F.col("ts_us") / 1_000_000)).cast("bigint").alias("at"), F.col("static_date").alias("start_date"),
        "route_id", "relationship", "stop_time_updates")


def _termini(t: Tables):
    """The stop listed at the middle of a trip's very first snapshot stands for its terminus."""
    first = t.snapshots.groupBy("trip_id").agg(
        F.min_by(F.get("stop_time_updates", 1)["stop_id"], F.struct("ts_us", "event_id")).alias("terminus_stop_id"))
    return first.join(t.trips.select("trip_id", F.col("start_date").alias("service_date")), "trip_id").withColumn(
        "scheduled_arrival", F.timestamp_seconds(F.unix_date("service_date").cast("bigint") * 86400 + 43200))


def _completions(t: Tables):
    rows = _update_rows(t)
    cycles = rows.select("at").distinct()
    return co.trip_completions(rows, _termini(t), cycles, timeout_s=TRIP_LOST_S, retention_s=TRIP_KEPT_S)


_COMPLETION = """
with recursive tm as (select trip_id, stop_id as terminus from v_snap_stus where idx = 1
  qualify row_number() over (partition by trip_id order by ts_us, event_id) = 1),
 r as (select s.event_id, s.trip_id, s.sec as c, s.route_id, s.relationship, v.start_date, tm.terminus,
   lag(s.sec) over (partition by s.trip_id order by s.sec) as before, p.prev_c
  from v_snaps s join (select c, lag(c) over (order by c) as prev_c from (select distinct sec as c from v_snaps
    where trip_id in (select trip_id from v_trips))) p on p.c = s.sec join v_trips v on v.trip_id = s.trip_id join tm on tm.trip_id = s.trip_id),
 u as (select event_id, stop_id, arr_time, dep_time, arr_delay from v_snap_stus
  qualify row_number() over (partition by event_id, stop_id order by idx) = 1),
 q as (select r.*, case when relationship = 'CANCELED' then 'cancelled'
   when u.arr_time is not null and u.dep_time is null then case when
    coalesce(u.arr_delay, u.arr_time - (cast(epoch(cast(start_date as timestamp)) as bigint) + 43200)) <= 299
    then 'on_time' else 'late' end end as outcome,
   case when relationship <> 'CANCELED' and u.dep_time is null then coalesce(u.arr_delay, u.arr_time - (cast(epoch(cast(start_date as timestamp)) as bigint) + 43200)) end as delay,
   sum(case when before is null or prev_c - before >= 259200 then 1 else 0 end) over (partition by r.trip_id order by c) as run
  from r left join u on u.event_id = r.event_id and u.stop_id = r.terminus),
 fin as (select q.*, coalesce(min(case when outcome is not null then c end) over (partition by trip_id, run order by c
    rows between current row and unbounded following), x.expired, (select max(c) from r)) as fin
  from q join (select trip_id as x_trip, run as x_run, (select min(c) from r where c >= max(q.c) + 259200) as expired
   from q group by 1, 2) x on x_trip = trip_id and x_run = run),
 nx as (select f.trip_id, f.c, (select min(g.c) from fin g where g.trip_id = f.trip_id and g.prev_c >= f.fin + 345600) as next_c
  from fin f),
 w as (select trip_id, min(c) as c from fin group by trip_id
  union all select w.trip_id, nx.next_c from w join nx on nx.trip_id = w.trip_id and nx.c = w.c where nx.next_c is not null)
select f.trip_id, strftime(f.start_date, '%Y-%m-%d') as service_date, f.fin as finalized_at,
 coalesce(o.outcome, 'undetermined_gap') as status, o.delay as delay_seconds,
 (select arg_max(route_id, c) from q where q.trip_id = f.trip_id and q.c between f.c and f.fin and q.run = f.run
  and route_id is not null) as route_id
from fin f join w on w.trip_id = f.trip_id and w.c = f.c
left join q o on o.trip_id = f.trip_id and o.c = f.fin and o.run = f.run and o.outcome is not null
"""


TRIP_LOST_S, TRIP_KEPT_S = 259_200, 345_600
KEEP = 259_200  # outcomes wait for a trip to turn into a ghost for so long


def _outcomes(t: Tables):
    """Known outcomes, at the poll cycle in which they became known."""
    known = co.resolutions_of(_completions(t))
    return known.select("trip_id", (F.floor(F.col("at") / CYCLE_S) * CYCLE_S).cast("bigint").alias("at"), "reason")


def _resolved_sql() -> str:
    """Each trip stepped through each cycle: one row of state per trip and tick, and what the tick emitted."""
    return f"""
with recursive ln as (select row_number() over (order by c) as i, c, backoff, coalesce(c - lag(c) over (order by c), 0) as d
  from (select ts_us // 21600000000 * {CYCLE_S} as c, count(*) filter (not ok) * 100 > 24 * count(*) as backoff from v_polls group by 1)),
 tc as (select trip_id, i, in_vp as pos from v_merged join ln on ln.c = cycle * {CYCLE_S}),
 rs as (select trip_id, i, case when status = 'cancelled' then 'cancelled' else 'completed' end as reason
  from ({_COMPLETION}) o join ln on ln.c = finalized_at // {CYCLE_S} * {CYCLE_S} where status <> 'undetermined_gap'),
 st as (
  select trip_id, 0::bigint as i, null::varchar as status, null::bigint as touched, null::bigint as seen, 0::bigint as elapsed,
   false as froze, null::bigint as start, null::varchar as res, null::bigint as res_at,
   null::varchar as ev, null::bigint as ev_at, null::bigint as ev_seen, null::bigint as ev_start, false as ev_froze
  from (select trip_id from tc union select trip_id from rs)
  union all
  select trip_id, i, case when marked then null else status end, case when marked then null else touched end,
   case when marked then null else seen end, case when marked then 0 else elapsed end, case when marked then false else froze end,
   case when marked then null else start end, case when r is not null and not marked then r else res end,
   case when r is not null and not marked then c else res_at end,
   case when marked then r else ev end, c, case when marked then seen else ev_seen end, case when marked then start else ev_start end,
   case when marked then froze else ev_froze end
  from (
   select trip_id, i, c, r, case when not gone then status end as status, case when not gone then touched end as touched,
    case when not gone then seen end as seen, case when gone then 0 else elapsed end as elapsed, not gone and froze as froze,
    case when not gone then start end as start, case when not gone and c - res_at < {KEEP} then res end as res,
    case when not gone and c - res_at < {KEEP} then res_at end as res_at,
    case when gone and status = 'ghost' then 'timed_out' else ev end as ev, case when gone then seen else ev_seen end as ev_seen,
    case when gone then start else ev_start end as ev_start, case when gone then froze else ev_froze end as ev_froze,
    r is not null and not gone and coalesce(status = 'ghost', false) as marked
   from (
    select trip_id, i, c, r, coalesce(c - touched >= {EVICT} and not out, false) as gone,
     case when out then null when pos then 'live' when not tracked then null when seen is null then 'ghost'
      when elapsed >= {COAST} then 'ghost' else 'coasting' end as status,
     case when not out then touched end as touched, case when out then null when pos then c else seen end as seen,
     case when out or pos then 0 else elapsed end as elapsed, not out and not pos and froze as froze,
     case when out or pos then null when elapsed >= {COAST} and seen is not null then coalesce(start, c) end as start,
     case when not out and not pos then res end as res, case when not out and not pos then res_at end as res_at,
     case when pos and was = 'ghost' then 'reappeared' when out then res end as ev, seen as ev_seen, start as ev_start,
     case when pos then was_froze else froze end as ev_froze
    from (
     select *, tracked and not pos and res is not null and (seen is null or elapsed >= {COAST}) as out from (
      select st.trip_id, ln.i, ln.c, rs.reason as r, st.status as was, st.seen, st.start, st.res, st.res_at, st.froze as was_froze,
       st.touched is not null or tc.trip_id is not null as tracked, coalesce(tc.pos, false) as pos,
       case when tc.trip_id is not null then ln.c else st.touched end as touched,
       case when st.seen is not null and not ln.backoff then st.elapsed + ln.d else st.elapsed end as elapsed,
       st.froze or (st.seen is not null and ln.backoff) as froze
      from st join ln on ln.i = st.i + 1 left join tc on tc.trip_id = st.trip_id and tc.i = ln.i
       left join rs on rs.trip_id = st.trip_id and rs.i = ln.i))))),
 ep as (select trip_id, ev as reason, ev_at as emitted_at, ev_seen as last_seen_at, ev_start as ghost_started_at, ev_froze as backoff_overlapped
   from st where ev is not null
  union all select trip_id, 'flushed', (select max(c) from ln), seen, start, froze from st
   where i = (select max(i) from ln) and status = 'ghost')
"""


@query("str05_resolved_episodes", f"""
{_resolved_sql()} select trip_id, reason, emitted_at, last_seen_at, ghost_started_at,
 cast(emitted_at - ghost_started_at as double) as ghost_duration_s, backoff_overlapped from ep""")
def _(t):
    found = lc.ghost_episodes(_touches(t), _cycles(t), _outcomes(t), coasting_s=COAST, max_age_s=EVICT, retention_s=KEEP)
    return found.select("trip_id", "reason", "emitted_at", "last_seen_at", "ghost_started_at", "ghost_duration_s", "backoff_overlapped")


def _streamed_completion_sql() -> str:
    """Each trip stepped through its rows: a gap ends a run at its time-out, not at the next poll."""
    rows = _COMPLETION[_COMPLETION.index("tm as"):_COMPLETION.index(" fin as (")].rstrip().rstrip(",")
    return f"""
with recursive {rows},
 s as (select trip_id, row_number() over (partition by trip_id order by c, event_id) as n, c, route_id, outcome, delay,
   strftime(start_date, '%Y-%m-%d') as day from q),
 st as (
  select distinct trip_id, 0::bigint as n, null::bigint as touched, null::bigint as final, null::varchar as route, null::varchar as day,
   null::bigint as gap_at, null::varchar as gap_route, null::varchar as gap_day, null::bigint as done_at, null::varchar as outcome, null::bigint as delay from s
  union all
  select trip_id, n, case when skip or outcome is not null then null else c end, case when skip then final when outcome is not null then c end,
   case when not skip then coalesce(row_route, route) end, case when not skip then coalesce(day, row_day) end, gap_at, gap_route, gap_day,
   case when not skip and outcome is not null then c end, case when not skip then outcome end, case when not skip then delay end
  from (
   select *, coalesce(c - final <= {TRIP_KEPT_S}, false) as skip from (
    select st.trip_id, s.n, s.c, s.route_id as row_route, s.day as row_day, s.outcome, s.delay,
     case when s.c - st.touched >= {TRIP_LOST_S} then st.touched + {TRIP_LOST_S} else st.final end as final,
     case when s.c - st.touched < {TRIP_LOST_S} then st.route end as route, case when s.c - st.touched < {TRIP_LOST_S} then st.day end as day,
     case when s.c - st.touched >= {TRIP_LOST_S} then st.touched + {TRIP_LOST_S} end as gap_at,
     case when s.c - st.touched >= {TRIP_LOST_S} then st.route end as gap_route, case when s.c - st.touched >= {TRIP_LOST_S} then st.day end as gap_day
    from st join s on s.trip_id = st.trip_id and s.n = st.n + 1)))
select trip_id, gap_route as route_id, gap_day as service_date, gap_at as finalized_s, 'undetermined_gap' as status, null::bigint as delay_seconds
 from st where gap_at is not null
union all select trip_id, route, day, done_at, outcome, delay from st where done_at is not null
union all select trip_id, route, day, touched + {TRIP_LOST_S}, 'undetermined_gap', null from st
 where touched is not null and n = (select max(n) from s where s.trip_id = st.trip_id)"""


@query("str06_trip_completions", _COMPLETION)
def _(t):
    return _completions(t).select("trip_id", F.col("service_date").cast("string").alias("service_date"), "finalized_at",
                                  "status", F.col("delay_seconds").cast("bigint").alias("delay_seconds"), "route_id")


@query("flt09_genuine_terminus", """
with f as (select trip_id, event_id, stop_id as want from v_snap_stus where idx = 2)
select f.event_id, u.arr_time as terminus_arrival from f join v_snap_stus u on u.event_id = f.event_id and u.stop_id = f.want
where u.arr_time is not null and u.dep_time is null
qualify row_number() over (partition by f.event_id order by idx) = 1""")
def _(t):
    u = co.terminus_update(F.col("stop_time_updates"), F.get("stop_time_updates", 2)["stop_id"])
    return t.snapshots.select("event_id", u["arr_time"].cast("bigint").alias("terminus_arrival")).filter(
        F.col("terminus_arrival").isNotNull())


# --- delay observations ---

_FEATURES = """
select s.event_id, s.trip_id, s.sec, s.route_id, coalesce(u.arr_delay, u.dep_delay) as current_delay_s,
 tt.n + 20 - u.stop_sequence as stops_remaining,
 s.route_id is not null and exists (select 1 from v_active_alerts a where a.no_entity or a.route_id is null
  or a.route_id = s.route_id) as active_alert_flag
from v_snaps s join v_snap_stus u on u.event_id = s.event_id and u.idx = 0
join (select trip_id, max(stop_sequence) as n from v_stop_times group by 1) tt on tt.trip_id = s.trip_id
where coalesce(u.arr_delay, u.dep_delay) is not null and tt.n + 20 - u.stop_sequence >= 0"""


def _features(t: Tables):
    termini = sc.trip_termini(t.stop_times).join(
        t.trips.select("trip_id", F.col("start_date").alias("service_date")), "trip_id").select(
        "trip_id", "service_date", (F.col("terminus_sequence") + 20).alias("terminus_sequence"))
    rows = t.snapshots.withColumn("at", F.floor(F.col("ts_us") / 1_000_000).cast("bigint")).drop("start_date").join(
        termini.select("trip_id", "service_date"), "trip_id")
    return ob.delay_features(rows, termini, t.alert_rows, ts(FEED_NOW))


@query("scl16_delay_features", f"""
select event_id, cast(current_delay_s as bigint) as current_delay_s, cast(stops_remaining as bigint) as stops_remaining,
 active_alert_flag from ({_FEATURES})""")
def _(t):
    return _features(t).select("event_id", F.col("current_delay_s").cast("bigint").alias("current_delay_s"),
                               F.col("stops_remaining").cast("bigint").alias("stops_remaining"), "active_alert_flag")


@query("str08_paced_observations", """
with s as (select trip_id, list(distinct sec order by sec) as l from (select s.trip_id, s.sec from v_snaps s
  where relationship <> 'CANCELED') group by trip_id)
select trip_id, unnest(list_reduce(l, lambda acc, x: case when x >= acc[1] + 43200 then list_prepend(x, acc) else acc end,
 [-1000000000])[:-2]) as observed_at from s""")
def _(t):
    rows = t.snapshots.withColumn("at", F.floor(F.col("ts_us") / 1_000_000).cast("bigint"))
    kept = ob.paced(ob.observable(rows).select("trip_id", "at").distinct(), interval_s=43_200, chunk_s=86_400)
    return kept.select("trip_id", F.col("at").alias("observed_at"))


@query("str15_last_good_features", """
with f as (select event_id, trip_id, sec, case when k % 4 <> 0 then k end as v from v_snaps),
 g as (select *, max(case when v is not null then sec end) over (partition by trip_id order by sec, event_id
   rows between unbounded preceding and 1 preceding) as good_at,
  last_value(v ignore nulls) over (partition by trip_id order by sec, event_id
   rows between unbounded preceding and 1 preceding) as good from f)
select event_id, case when v is not null then v when sec - good_at <= 86400 then good end as value,
 v is null and coalesce(sec - good_at <= 86400, false) as stale from g""")
def _(t):
    rows = t._events.filter(F.col("event_type").isin("purchase", "signup")).select(
        "event_id", F.col("user_id").cast("string").alias("trip_id"), F.floor(F.col("ts_us") / 1_000_000).cast("bigint").alias("at"),
        F.when(F.col("k") % 4 != 0, F.struct("k")).alias("features"))
    filled = ob.with_last_good(rows, tie="event_id", max_age_s=86_400)
    return filled.select("event_id", F.col("features.k").alias("value"), "stale")


# --- headway ---


def _dwell_states(t: Tables):
    """Completed trips as a state history: each static call is one cycle at its stop."""
    calls = t.stop_times.join(t.trips.select("trip_id", "route_id", "direction_id", "trip_no"), "trip_id")
    repeated = F.explode(F.array(F.lit(0), F.lit(60))).alias("later")
    return calls.select("trip_id", "stop_id", "arr_s", "route_id", "direction_id", "stop_sequence", repeated).select(
        "trip_id", (F.col("arr_s") + F.col("later")).alias("at"),
        F.when(F.col("stop_sequence") % 5 == 0, "between").otherwise("at").alias("status"),
        F.col("stop_id").alias("at_stop_id"), "route_id",
        F.when(F.col("trip_id").cast("bigint") % 9 != 0, F.col("direction_id")).alias("direction_id"))


_ARRIVALS = """
with c as (select trip_id, arr_s + x as c, case when stop_sequence % 5 <> 0 then stop_id end as st, route_id,
  case when trip_no % 9 <> 0 then direction_id end as direction_id
  from (select s.trip_id, s.arr_s, s.stop_sequence, s.stop_id, t.route_id, t.direction_id, t.trip_no
   from v_stop_times s join v_trips t on t.trip_id = s.trip_id), (values (0), (60)) v(x)),
 p as (select *, lag(st) over (partition by trip_id order by c) as prev from c),
 ar as (select st as stop_id, route_id, direction_id, trip_id, c as arrived_at from p
  where st is not null and st is distinct from prev and direction_id is not null and c > (select min(c) from c))
"""


@query("win10_arrival_edges", f"{_ARRIVALS} select * from ar")
def _(t):
    return hw.arrivals(_dwell_states(t))


@query("win08_rolling_headway", f"""
{_ARRIVALS}, n as (select *, row_number() over w as rn, lag(arrived_at, 5) over w as six,
  first_value(arrived_at) over w as f from ar
  window w as (partition by stop_id, route_id, direction_id order by arrived_at, trip_id))
select stop_id, route_id, direction_id, trip_id, arrived_at, least(rn, 6) as sample_size,
 case when rn > 1 then round((arrived_at - coalesce(six, f))::double / (least(rn, 6) - 1), 6) end as average_headway_seconds from n""")
def _(t):
    return hw.rolling_headways(hw.arrivals(_dwell_states(t))).withColumn(
        "average_headway_seconds", F.round("average_headway_seconds", 6)).withColumn(
        "sample_size", F.col("sample_size").cast("bigint"))


_HEADWAY = f"""
{_ARRIVALS}, n as (select stop_id, route_id, direction_id, count(*) as sample_size, min(arrived_at) as a, max(arrived_at) as b
  from (select * from ar where arrived_at <= 72000 qualify row_number() over
   (partition by stop_id, route_id, direction_id order by arrived_at desc, trip_id) <= 6) group by all),
 hw as (select stop_id, route_id, direction_id, sample_size, case when sample_size > 1 then
  round((b - a)::double / (sample_size - 1), 6) end as average_headway_seconds, 72000 - b as seconds_since_last_arrival,
  sample_size >= 3 and b > a and (72000 - b) > 2.0 * (b - a) / (sample_size - 1) as gap_detected from n)"""


def _headways(t: Tables):
    h = hw.headways_at(hw.arrivals(_dwell_states(t)), F.lit(72_000))
    return h.withColumn("average_headway_seconds", F.round("average_headway_seconds", 6))


@query("str09_headway_at", f"{_HEADWAY} select * from hw")
def _(t):
    return _headways(t)


@query("win09_bunching_gaps", f"{_HEADWAY} select stop_id, route_id, direction_id from hw where gap_detected")
def _(t):
    return _headways(t).filter("gap_detected").select("stop_id", "route_id", "direction_id")


@query("join29_station_board", f"""
{_HEADWAY} select d.station_id, d.trip_id, d.stop_id, d.scheduled_s, d.predicted_s, d.is_live, d.is_cancelled, d.platform_code,
 coalesce(h.sample_size, 0) as sample_size, h.average_headway_seconds, coalesce(h.gap_detected, false) as gap_detected,
 s.wheelchair from v_overlay d left join hw h on h.stop_id = d.stop_id and h.route_id = d.route_id
 and h.direction_id = d.direction_id left join v_stops s on s.stop_id = d.station_id
qualify row_number() over (partition by d.station_id, d.direction_id order by scheduled_s, d.trip_id, d.stop_id) <= 3""")
def _(t):
    shown = sc.live_overlay(sc.top_per_direction(_departures(t)), t.latest_snapshots, t.stops)
    board = vw.station_board(shown, _headways(t), t.stops)
    return board.select(
        "station_id", "trip_id", "stop_id", epoch("scheduled_at").alias("scheduled_s"), epoch("predicted_at").alias("predicted_s"),
        "is_live", "is_cancelled", "platform_code", "sample_size", "average_headway_seconds", "gap_detected", "wheelchair")


# --- views ---


def _now_s():
    return F.lit(1706659200)


_LIVE = """l as (select * from v_latest_snaps where trip_id in
  (select trip_id from v_merged where cycle = (select max(cycle) from v_merged)))"""


def _live_snapshots(t: Tables):
    """Newest snapshot of the trips in the latest merged cycle."""
    cycles = merged(t).select("cycle", "trip_id")
    latest = cycles.join(F.broadcast(cycles.agg(F.max("cycle").alias("cycle"))), "cycle", "left_semi")
    return t.latest_snapshots.join(latest, "trip_id", "left_semi")


@query("join25_current_trains", f"""
{_TRACKED}, {_ANCHORS.strip()[5:]}, {_LIVE},
 n as (select trip_id, max(stop_sequence) as total from v_stop_times group by 1), sk as ({_SKIP})
select tr.trip_id, tr.status, l.route_id, nullif(t.headsign, '') as headsign, t.direction_id,
 y.next_stop_id, s.name as next_stop_name,
 case when l.trip_id is not null and y.progress_sequence is not null then n.total end as progress_total_stops,
 case when l.trip_id is not null and n.total is not null then y.progress_sequence end as progress_stop_sequence,
 case when l.trip_id is not null then sk.skipped_stop_count end as skipped_stop_count
from tr left join l on l.trip_id = tr.trip_id left join sk on sk.trip_id = tr.trip_id left join v_trips t on t.trip_id = tr.trip_id left join n on n.trip_id = tr.trip_id
left join (select event_id, next_stop_id, progress_sequence from z) y on y.event_id = l.event_id
left join v_stops s on s.stop_id = y.next_stop_id""")
def _(t):
    # each snapshot is judged at its own instant here
    skips = sc.skip_stop_counts(t.trips, t.stop_times, t.stops, t.routes, loop_stations=("P3", "P7", "P11"))
    termini = sc.trip_termini(t.stop_times).select("trip_id", "terminus_sequence")
    live = _live_snapshots(t)
    trains = vw.current_trains(_tracked(t), live, t.trips.select("trip_id", "headsign", "direction_id"), t.stops, termini,
                               skips, epoch("now_at"))
    return trains.select("trip_id", "status", "route_id", "headsign", "direction_id", "next_stop_id", "next_stop_name",
                         "progress_total_stops", "progress_stop_sequence", "skipped_stop_count")


@query("join26_network_state", f"""
{_TRACKED} select 'trains' as part, cast(count(*) as bigint) as n from tr where 1706659200 - last_touched_at <= 86400
union all select 'stale_feeds', count(*) from (select feed, max(ts_us // 1000000) filter (is_change) as x from (
  select *, row_number() over w = 1 or header_ts is distinct from lag(header_ts) over w as is_change
  from v_polls window w as (partition by feed order by ts_us)) group by feed) where 1706659200 - x > 600
union all select 'backoff', cast(arg_max(backoff, c) as bigint) from cy""")
def _(t):
    polls = t.polls.withColumn("at", F.floor(F.col("ts_us") / 1_000_000).cast("bigint")).withColumn("header", F.col("header_ts"))
    state = vw.network_state(_tracked(t), qu.feed_age(polls, _now_s(), 600), _cycles(t), _now_s(), 86400)
    n = F.count(F.lit(1)).alias("n")
    return (
        state["trains"].agg(F.lit("trains").alias("part"), n)
        .unionByName(state["feeds"].filter("is_stale").agg(F.lit("stale_feeds").alias("part"), n))
        .unionByName(state["backoff"].select(F.lit("backoff").alias("part"), F.col("backoff_active").cast("bigint").alias("n")))
    )


@query("join27_trip_details", f"""
{_TRACKED}, {_LIVE}
select coalesce(l.trip_id, tr.trip_id) as trip_id, tr.status, case when l.trip_id is not null then 'live'
 when tr.last_seen_at is not null then 'last_confirmed' end as position_source, l.route_id,
 case when l.trip_id is not null then l.relationship = 'CANCELED' end as is_cancelled,
 case when l.trip_id is not null then l.relationship = 'ADDED' end as is_added,
 cast(case when l.trip_id is not null then 3 else 0 end as integer) as stops, tr.last_seen_at
from l full join tr on tr.trip_id = l.trip_id""")
def _(t):
    return vw.trip_details(_live_snapshots(t), _tracked(t), _now_s()).select(
        "trip_id", "status", "position_source", "route_id", "is_cancelled", "is_added", F.size("stops").alias("stops"),
        "last_seen_at")


@query("join28_line_status", f"""
{_TRACKED}, l as (select * from v_latest_snaps where route_id in ('R1:', 'R1-R:'))
select count(*) filter (status = 'live') as live, count(*) filter (status = 'coasting') as coasting,
 count(*) filter (status = 'ghost') as ghost, count(*) filter (relationship = 'CANCELED') as cancelled,
 (select count(*) from v_active_alerts where no_entity or route_id is null or route_id in ('R1:', 'R1-R:')) as alerts
from l left join tr on tr.trip_id = l.trip_id""")
def _(t):
    parts = vw.line_status(t.latest_snapshots, _tracked(t), t.alert_rows, t.routes, "nation_1", _now_s(), ts(FEED_NOW))
    one = F.lit(1).alias("_one")
    counts = parts["counts"].withColumn("_one", F.lit(1))
    cancelled = parts["cancelled"].agg(F.count(F.lit(1)).alias("cancelled"), one)
    alerts = parts["alerts"].agg(F.count(F.lit(1)).alias("alerts"), one)
    return counts.join(F.broadcast(cancelled), "_one").join(F.broadcast(alerts), "_one").drop("_one")  # one row each


# --- model ---


def _examples(t: Tables):
    return md.label_observations(t.observations, t.completions, ["seq"])


_EXAMPLES = """
with lb as (select trip_id, service_date, arg_max(delay_seconds, seq) as final_delay_s from v_completions
  where status not in ('cancelled', 'undetermined_gap') and delay_seconds is not null group by all),
 ex as (select o.*, lb.final_delay_s from v_observations o join lb using (trip_id, service_date)),
 dy as (select service_date, dense_rank() over (order by service_date desc) as rk from (select distinct service_date from ex)),
 mk as (select ex.*, rk <= 300 as is_test from ex join dy using (service_date))"""


@query("join20_labelled_observations", f"""
{_EXAMPLES} select trip_id, cast(seq as bigint) as seq, cast(current_delay_s as bigint) as current_delay_s,
 cast(final_delay_s as bigint) as final_delay_s from ex""")
def _(t):
    return _examples(t).select("trip_id", F.col("seq").cast("bigint").alias("seq"),
                               *[F.col(c).cast("bigint").alias(c) for c in ("current_delay_s", "final_delay_s")])


@query("win18_train_test_split", f"""
{_EXAMPLES} select is_test, count(*) as n, count(distinct service_date) as days from mk group by is_test""")
def _(t):
    marked = md.mark_test_days(_examples(t), 300)
    return marked.groupBy("is_test", "service_date").agg(F.count(F.lit(1)).alias("c")).groupBy("is_test").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("days"))


@query("ml03_naive_baseline", f"""
{_EXAMPLES} select is_test, round(avg(abs(final_delay_s - current_delay_s)), 6) as baseline_mae from mk group by is_test""")
def _(t):
    marked = md.mark_test_days(_examples(t), 300)
    return marked.groupBy("is_test").agg(F.round(F.avg(F.abs(F.col("final_delay_s") - md.baseline())), 6).alias("baseline_mae"))


@query("ml01_least_squares_sums", f"""
{_EXAMPLES} select count(*)::double as a00, sum(current_delay_s)::double as a01, sum(stops_remaining)::double as a02,
 sum(current_delay_s * current_delay_s)::double as a11, sum(current_delay_s * final_delay_s)::double as b1,
 sum(final_delay_s)::double as b0 from mk where not is_test""")
def _(t):
    train = md.compact(md.mark_test_days(_examples(t), 300).filter(~F.col("is_test")))
    n, x, s, y = (F.col(c).cast("double") for c in ("n", "current_delay_s", "stops_remaining", "final_delay_s"))
    return train.agg(F.sum(n).alias("a00"), F.sum(n * x).alias("a01"), F.sum(n * s).alias("a02"), F.sum(n * x * x).alias("a11"),
                     F.sum(n * x * y).alias("b1"), F.sum(n * y).alias("b0"))


def _fitted(t: Tables):
    return md.mark_test_days(_examples(t), 300)


_SIMPLE = "current_delay_s + 3 * stops_remaining - 20 * cast(active_alert_flag as integer)"


@query("ml01_least_squares_recovers_line", f"""
{_EXAMPLES} select 'intercept' as term, 5.0::double as weight union all select 'current_delay_s', 1.0
union all select 'stops_remaining', 3.0 union all select 'active_alert_flag', -20.0""")
def _(t):
    exact = t.observations.withColumn("final_delay_s", F.expr(f"5 + {_SIMPLE}"))
    model = md.fit_linear(md.compact(exact))
    terms = zip(("intercept", *md.FEATURES), (model.intercept, *model.weights))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.lit(round(w, 3)).alias("weight")) for n, w in terms]))
    return t.spark.range(1).select(rows.alias("r")).select("r.*")


@query("ml02_least_absolute_fit")
def _(t):
    marked = _fitted(t)
    model = md.fit_least_absolute(marked.filter(~F.col("is_test")))
    return md.evaluate(model, marked.filter("is_test"))


def _terms_of(t: Tables, model):
    terms = zip(("intercept", *md.FEATURES), (model.intercept, *model.weights))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.lit(round(w, 1)).alias("weight")) for n, w in terms]))
    return t.spark.range(1).select(rows.alias("r")).select("r.*")


@query("ml02_absolute_fit_recovers_line", f"""
{_EXAMPLES} select 'intercept' as term, 5.0::double as weight union all select 'current_delay_s', 1.0
union all select 'stops_remaining', 3.0 union all select 'active_alert_flag', -20.0""")
def _(t):
    """A line with an hour's error in every ninth example, early or late: a fit by squares would follow those, this one must not."""
    part = F.pmod(F.xxhash64("trip_id", "seq"), F.lit(18))
    off = F.when(part == 0, 3600).when(part == 9, -3600).otherwise(0)
    return _terms_of(t, md.fit_least_absolute(t.observations.withColumn("final_delay_s", F.expr(f"5 + {_SIMPLE}") + off)))


@query("agg35_model_error", f"""
{_EXAMPLES} select round(avg(abs(final_delay_s - (10 + 0.5::double * current_delay_s + 2 * stops_remaining
 - 4 * cast(active_alert_flag as integer)))), 6) as model_mae, round(avg(abs(final_delay_s - current_delay_s)), 6) as baseline_mae,
 count(*) as examples from mk where is_test""")
def _(t):
    scores = md.evaluate(md.DelayModel(10.0, (0.5, 2.0, -4.0)), _fitted(t).filter("is_test"))
    return scores.withColumns({c: F.round(c, 6) for c in ("model_mae", "baseline_mae")})


@query("ml04_gate")
def _(t):
    g = md.train_and_gate(_examples(t), 300)
    return t.spark.range(1).select(F.lit(g.passed).alias("passed"), F.lit(g.train_examples).alias("train_examples"),
                                   F.lit(g.test_examples).alias("test_examples"))


@query("ml04_gate_decisions", f"""
{_EXAMPLES}, n as (select count(*) filter (not is_test) as train_examples, count(*) filter (is_test) as test_examples from mk)
select 'line' as kind, true as passed, train_examples, test_examples from n
union all select 'unchanged', false, train_examples, test_examples from n""")
def _(t):
    """A model that explains the delay beats the baseline; where the delay just stays as it is, none can."""
    examples = checkpointed(_examples(t).select("service_date", *md.FEATURES, "final_delay_s"))  # both gates read the join's rows
    gates = [(kind, md.train_and_gate(examples.withColumn("final_delay_s", F.expr(e).cast("bigint")), 300))
             for kind, e in (("line", f"5 + {_SIMPLE}"), ("unchanged", "current_delay_s"))]
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("kind"), F.lit(g.passed).alias("passed"), F.lit(g.train_examples).cast("bigint").alias("train_examples"),
        F.lit(g.test_examples).cast("bigint").alias("test_examples")) for k, g in gates]))
    return t.spark.range(1).select(rows.alias("r")).select("r.*")


_SCORE = "10 + 0.5::double * current_delay_s + 2 * stops_remaining - 4 * cast(active_alert_flag as integer)"


@query("scl20_prediction", f"""
select trip_id, cast(seq as bigint) as seq, round({_SCORE}, 6) as predicted from v_observations""")
def _(t):
    return t.observations.select("trip_id", F.col("seq").cast("bigint").alias("seq"),
                                 F.round(md.prediction(md.DelayModel(10.0, (0.5, 2.0, -4.0))), 6).alias("predicted"))


@query("ml06_batch_scoring", f"""
select event_id, cast(round_even({_SCORE}, 0) as bigint) as predicted_delay_seconds from ({_FEATURES})""")
def _(t):
    return md.score(_features(t), md.DelayModel(10.0, (0.5, 2.0, -4.0))).select("event_id", "predicted_delay_seconds")
