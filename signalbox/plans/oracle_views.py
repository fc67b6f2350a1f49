"""The canonical views as SQL, inlined into oracle statements as needed."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_routes": """
select case when n_nationkey < 20 then 'R'||n_nationkey||':' else 'R'||(n_nationkey-20)||'-R:' end as route_id,
 case when n_nationkey < 20 then n_name else 'Replacement Bus' end as short_name,
 'NATION_'||(n_nationkey % 20) as long_name
from nation""",
    "v_trips": """
select o_orderkey as trip_no, cast(o_orderkey as varchar) as trip_id,
 case when c_nationkey < 20 then 'R'||c_nationkey||':' else 'R'||(c_nationkey-20)||'-R:' end as route_id,
 o_orderpriority as service_id, cast(o_orderkey % 2 as integer) as direction_id,
 cast(o_orderdate as date) as start_date, o_orderstatus as order_status,
 case when o_orderkey % 10 = 0 then '' else c_mktsegment end as headsign,
 case when o_orderkey % 4 <> 0 then 'SH'||(o_orderkey % 5) end as shape_id,
 'D'||year(o_orderdate) as digest
from orders join customer on o_custkey = c_custkey""",
    "v_lines": """
select l_orderkey, l_partkey, l_suppkey, l_quantity,
 row_number() over w as seq, row_number() over w = count(*) over (partition by l_orderkey) as is_last
from lineitem window w as (partition by l_orderkey
 order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)""",
    "v_stop_times": """
select *, lpad(cast(arr_s // 3600 as varchar), 2, '0')||':'||lpad(cast(arr_s % 3600 // 60 as varchar), 2, '0')||':'
  ||lpad(cast(arr_s % 60 as varchar), 2, '0') as arrival_time,
 lpad(cast(dep_s // 3600 as varchar), 2, '0')||':'||lpad(cast(dep_s % 3600 // 60 as varchar), 2, '0')||':'
  ||lpad(cast(dep_s % 60 as varchar), 2, '0') as departure_time
from (select l_orderkey as trip_no, cast(l_orderkey as varchar) as trip_id, seq as stop_sequence,
  'S'||l_suppkey as stop_id, 18000 + (l_orderkey*7919) % 79200 + seq*180 as arr_s,
  case when not is_last then 18000 + (l_orderkey*7919) % 79200 + seq*180 + 30 end as dep_s from v_lines)""",
    "v_stops": """
select 'S'||s_suppkey as stop_id, 'Stop '||s_suppkey as name, 'P'||s_nationkey as parent_station,
 0 as location_type, cast(-37.82 as double) + (s_suppkey % 20) * cast(0.001 as double) as lat,
 cast(144.955 as double) + (s_nationkey % 25) * cast(0.001 as double) as lon,
 cast(s_suppkey % 4 + 1 as varchar) as platform_code, cast(null as integer) as wheelchair
from supplier
union all
select distinct 'P'||s_nationkey, 'NATION_'||s_nationkey||' Railway Station', null, 1,
 cast(-37.82 as double) + (s_nationkey % 20) * cast(0.001 as double),
 cast(144.955 as double) + (s_nationkey % 25) * cast(0.001 as double), null, s_nationkey % 3
from supplier""",
    "v_calendar": """
select * from (values
 ('1-URGENT', true, true, true, true, true, true, true, DATE '1995-01-01', DATE '2001-12-31'),
 ('2-HIGH', true, true, true, true, true, false, false, DATE '1995-01-01', DATE '2001-12-31'),
 ('3-MEDIUM', false, false, false, false, false, true, true, DATE '1995-01-01', DATE '2001-12-31'),
 ('4-NOT SPECIFIED', true, false, true, false, true, false, false, DATE '1995-01-01', DATE '2001-12-31'),
 ('5-LOW', false, true, false, true, false, true, false, DATE '1995-01-01', DATE '2001-12-31'))
as c(service_id, monday, tuesday, wednesday, thursday, friday, saturday, sunday, start_date, end_date)""",
    "v_calendar_dates": """
select * from (values ('2-HIGH', DATE '1998-06-15', 2), ('3-MEDIUM', DATE '1998-06-15', 1),
 ('1-URGENT', DATE '1998-06-16', 2), ('5-LOW', DATE '1998-06-17', 1)) as c(service_id, date, exception_type)""",
    "v_service_days": """
select d as service_date, service_id from (select distinct start_date as d from v_trips) x, v_calendar
where d between start_date and end_date
 and list_extract([monday, tuesday, wednesday, thursday, friday, saturday, sunday], cast(isodow(d) as integer))
 and not exists (select 1 from v_calendar_dates e where e.date = d and e.service_id = v_calendar.service_id
   and exception_type = 2)
union
select date, service_id from v_calendar_dates where exception_type = 1
 and date in (select start_date from v_trips)""",
    "v_pins": """
select distinct cast(o_orderdate as date) as service_date, 'D'||year(o_orderdate) as digest
from orders where day(o_orderdate) <> 31""",
    "v_completions": """
select start_date as service_date, trip_id,
 case when (l_orderkey*7 + seq) % 41 <> 0 then route_id end as route_id, seq,
 case when order_status = 'P' then case when (l_orderkey + seq) % 2 = 0 then 'cancelled' else 'undetermined_gap' end
  when delay <= 299 then 'on_time' else 'late' end as status,
 case when order_status <> 'P' then delay end as delay_seconds,
 case when order_status <> 'P' then to_timestamp_naive end as actual_at
from (select *, (l_partkey*37 + seq*101) % 1500 - 300 as delay,
  cast(start_date as timestamp) + to_seconds((l_suppkey*911 + l_orderkey*677) % 86400) as to_timestamp_naive
 from v_lines join v_trips on l_orderkey = trip_no)""",
    "v_first_completions": """
select * from v_completions
qualify row_number() over (partition by service_date, trip_id order by seq) = 1""",
    "v_observations": """
select start_date as service_date, trip_id, route_id, seq,
 (l_partkey*37 + (seq-1)*101) % 1500 - 300 as current_delay_s,
 (l_suppkey*13 + seq) % 12 as stops_remaining, l_suppkey % 2 = 1 as active_alert_flag
from v_lines join v_trips on l_orderkey = trip_no""",
    "v_events": """
select event_id, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
 epoch_us(ts) as ts_us, ts from events""",
    "v_polls": """
select event_id as poll_id, ts_us, case event_id % 3 when 0 then 'vehicle_positions' when 1 then 'trip_updates'
  else 'service_alerts' end as feed, event_type <> 'error' as ok, k as remaining,
 ts_us // 3600000000 * 3600 as header_ts, k % 7 as n_entities,
 case when event_type = 'error' then 'http_'||(k % 4 + 500) end as error
from v_events""",
    "v_positions": """
select event_id, ts_us, cast(user_id as varchar) as trip_id,
 'R'||((user_id + case when k % 10 = 0 then 1 else 0 end) % 20)||':' as route_id,
 cast(-37.82 as double) + (k % 20) * cast(0.001 as double) as lat,
 cast(144.955 as double) + (cast(floor(value) as bigint) % 25) * cast(0.001 as double) as lon, k,
 strftime(ts, '%Y%m%d') as start_date, lpad(cast(user_id % 24 as varchar), 2, '0')||':00:00' as start_time
from v_events where event_type in ('view', 'click')""",
    "v_trip_updates": """
select event_id, ts_us, cast(user_id as varchar) as trip_id,
 case when k % 31 <> 0 then 'R'||(user_id % 20)||':' end as route_id, k % 12 + 1 as stop_sequence,
 'S'||((user_id + k % 12 + 1) % 10) as stop_id, cast(floor(value * 10) as bigint) - 200 as delay,
 case when k % 25 = 0 then 'CANCELED' when k % 25 = 1 then 'ADDED' else 'SCHEDULED' end as relationship,
 case when k % 6 <> 0 then ts_us // 1000000 + 120 end as arr_time,
 case when k % 8 <> 0 then ts_us // 1000000 + 150 end as dep_time,
 strftime(ts, '%Y%m%d') as start_date, lpad(cast(user_id % 24 as varchar), 2, '0')||':00:00' as start_time
from v_events where event_type in ('purchase', 'signup')""",
    "v_cycle_vp": """
select ts_us // 21600000000 as cycle, * from v_positions
qualify row_number() over (partition by ts_us // 21600000000, trip_id order by ts_us desc, event_id desc) = 1""",
    "v_cycle_tu": """
select ts_us // 21600000000 as cycle, * from v_trip_updates
qualify row_number() over (partition by ts_us // 21600000000, trip_id order by ts_us desc, event_id desc) = 1""",
    "v_merged": """
select coalesce(t.cycle, v.cycle) as cycle, coalesce(t.trip_id, v.trip_id) as trip_id, t.route_id, t.start_date,
 t.start_time, t.relationship, t.delay, t.stop_sequence, t.stop_id, t.arr_time, t.dep_time,
 t.ts_us as schedule_us, v.ts_us as position_us, v.lat, v.lon,
 v.route_id as vp_route_id, v.start_date as vp_start_date, v.start_time as vp_start_time,
 t.trip_id is not null as in_tu, v.trip_id is not null as in_vp
from v_cycle_tu t full join v_cycle_vp v on t.cycle = v.cycle and t.trip_id = v.trip_id""",
    "v_discrepancies": """
select cycle, trip_id, kind as discrepancy_type, tu_value, vp_value from (
 select cycle, trip_id, 'vp_without_tu' as kind, cast(null as varchar) as tu_value, vp_route_id as vp_value
  from v_merged where in_vp and not in_tu
 union all select cycle, trip_id, 'route_id_mismatch', route_id, vp_route_id from v_merged
  where in_tu and vp_route_id is not null and route_id is distinct from vp_route_id
 union all select cycle, trip_id, 'start_time_mismatch', start_time, vp_start_time from v_merged
  where in_tu and vp_start_time is not null and start_time is distinct from vp_start_time
 union all select cycle, trip_id, 'start_date_mismatch', start_date, vp_start_date from v_merged
  where in_tu and vp_start_date is not null and start_date is distinct from vp_start_date)""",
    "v_gaps": """
select * from (select event_id, trip_id, ts_us // 1000000 as at, lat, lon,
 lead(ts_us // 1000000) over w as next_at, lead(lat) over w as next_lat, lead(lon) over w as next_lon,
 lead(ts_us // 1000000) over w - ts_us // 1000000 as gap_s,
 2 * 6371000.0 * asin(sqrt(pow(sin(radians(lead(lat) over w - lat) / 2), 2) + cos(radians(lat))
  * cos(radians(lead(lat) over w)) * pow(sin(radians(lead(lon) over w - lon) / 2), 2))) as distance_m
 from v_positions window w as (partition by trip_id order by ts_us // 1000000, event_id)) where next_at is not null""",
    "v_freezes": """
select trip_id, count(*) as fixes, min(at) as started_at, max(at) as ended_at, max(at) - min(at) as duration_s
from (select *, sum(case when moved then 1 else 0 end) over (partition by trip_id order by at, event_id) as run
 from (select event_id, trip_id, ts_us // 1000000 as at, lat, lon,
   (lat is distinct from lag(lat) over w or lon is distinct from lag(lon) over w) as moved
  from v_positions where lat between -37.815 and -37.808 and lon between 144.962 and 144.975
  window w as (partition by trip_id order by ts_us // 1000000, event_id)))
group by trip_id, run having count(*) >= 2""",
    "v_header_changes": """
select *, case when is_change then header - last_value(case when is_change then header end ignore nulls)
 over (partition by feed order by at, poll_id rows between unbounded preceding and 1 preceding) end as step
from (select poll_id, feed, ts_us / 1000000.0 as at, header_ts as header,
  row_number() over w = 1 or header_ts is distinct from lag(header_ts) over w as is_change
 from v_polls where ok window w as (partition by feed order by ts_us))""",
    "v_outages": """
select ended_at, min(at) as started_at, count(*) as bad_cycles, count(*) filter (not ok) as consecutive_failures
from (select ts_us // 1000000 as at, ok, not ok or remaining <= 5 as is_bad,
  min(case when ok and remaining > 5 then ts_us // 1000000 end)
   over (order by ts_us rows between 1 following and unbounded following) as ended_at from v_polls)
where is_bad and ended_at is not null group by ended_at""",
    "v_spans": """
select trip_id, service_id, min(arr_s) as start_s, max(dep_s) as end_s
from v_stop_times join v_trips using (trip_id) group by all""",
    "v_live": """
select distinct ts_us // 3600000000 * 3600 - 806198400 as at, trip_id from v_positions""",
    "v_samples": """
select unnest(generate_series(min(at), max(at), 300)) as sample_at from v_live""",
    "v_running": """
with l as (select sample_at, timezone('Australia/Melbourne', to_timestamp(sample_at)) as t from v_samples),
 x as (select sample_at, cast(t as date) as d, hour(t)*3600 + minute(t)*60 + cast(floor(second(t)) as bigint) as s, 0 as lo
  from l union all select sample_at, cast(t as date) - 1, hour(t)*3600 + minute(t)*60 + second(t) + 86400, 86400 from l)
select sample_at, trip_id from x join v_all_service_days a on a.service_date = x.d
join v_spans p on p.service_id = a.service_id and p.start_s <= s and s <= p.end_s and p.start_s >= lo""",
    "v_all_service_days": """
select d as service_date, service_id from (select cast(unnest(generate_series(TIMESTAMP '1995-01-01',
  TIMESTAMP '2001-12-31', interval 1 day)) as date) as d) x, v_calendar
where list_extract([monday, tuesday, wednesday, thursday, friday, saturday, sunday], cast(isodow(d) as integer))
 and not exists (select 1 from v_calendar_dates e where e.date = d and e.service_id = v_calendar.service_id
   and exception_type = 2)
union select date, service_id from v_calendar_dates where exception_type = 1""",
    "v_alerts": """
select cast(p_partkey as varchar) as id, p_partkey as pos, p_type as effect, p_name as header_text,
 case when p_partkey % 3 <> 0 then 'R'||(p_partkey % 20)||':' end as route_id,
 case when p_partkey % 5 = 0 then 'S'||(p_partkey % 10) end as stop_id,
 case when p_partkey % 4 <> 0 then cast(p_partkey % 2 as integer) end as direction_id,
 case when p_partkey % 7 <> 0 then TIMESTAMP '2024-01-01' + to_days(cast(p_partkey % 30 as integer)) end as start_at,
 TIMESTAMP '2024-01-01' + to_days(cast(p_partkey % 30 + p_size as integer)) as end_at,
 p_partkey % 14 = 0 as no_period, p_partkey % 11 = 0 as no_entity
from part""",
    "v_active_alerts": """
select * from v_alerts where no_period
 or ((start_at is null or start_at <= TIMESTAMP '2024-01-16') and end_at >= TIMESTAMP '2024-01-16')""",
    "v_snaps": """
select event_id, ts_us, cast(user_id as varchar) as trip_id,
 case when k % 31 <> 0 then 'R'||(user_id % 20)||':' end as route_id,
 case when k % 25 = 0 then 'CANCELED' when k % 25 = 1 then 'ADDED' else 'SCHEDULED' end as relationship,
 ts_us // 1000000 + (k * 7) % 900 - 300 as now_s, strftime(ts, '%Y%m%d') as start_date, k, user_id,
 cast(floor(value * 10) as bigint) - 200 as delay, ts_us // 1000000 as sec,
 cast(-37.82 as double) + (k % 20) * cast(0.001 as double) as lat,
 cast(144.955 as double) + (user_id % 25) * cast(0.001 as double) as lon
from v_events where event_type in ('purchase', 'signup')""",
    "v_snap_stus": """
select s.*, i as idx, k % 12 + 1 + i as stop_sequence, 'S'||((user_id + k % 12 + 1 + i) % 10) as stop_id,
 case when (k + i) % 13 = 0 then 'SKIPPED' else 'SCHEDULED' end as stu_relationship,
 case when (k + i) % 6 <> 0 then sec + i * 300 - 200 end as arr_time,
 case when (k + i) % 8 <> 0 then sec + i * 300 - 170 end as dep_time,
 case when (k + i) % 5 <> 0 then delay end as arr_delay, case when (k + i) % 4 <> 0 then delay + 10 end as dep_delay
from v_snaps s, (values (0), (1), (2)) as x(i)""",
    "v_latest_snaps": """
select * from v_snaps qualify row_number() over (partition by trip_id order by ts_us desc, event_id desc) = 1""",
    "v_latest_stus": """
select * from v_snap_stus where event_id in (select event_id from v_latest_snaps)""",
    "v_shapes": """
select 'SH'||(c_custkey % 6) as shape_id, c_custkey // 6 as shape_pt_sequence,
 cast(-37.9 as double) + (c_custkey % 97) * cast(0.001 as double) as lat,
 cast(144.9 as double) + (c_custkey % 89) * cast(0.001 as double) as lon from customer""",
    "v_alert_stops": """
select cast(p_partkey as varchar) as alert_id, i as ordinal, 'S'||((p_partkey + i * 7) % 10) as stop_id
from part, (values (0), (1), (2)) as x(i) where i <= p_partkey % 3""",
    "v_home_lines": """
select 'S'||s_suppkey as stop_id, case when s_nationkey < 20 then 'R'||s_nationkey||':'
 else 'R'||(s_nationkey-20)||'-R:' end as route_id from supplier""",
    "v_platforms": """
select parent_station as station_id, stop_id from v_stops where parent_station is not null
union all select stop_id, stop_id from v_stops
where stop_id not in (select parent_station from v_stops where parent_station is not null)""",
    "v_stop_routes": """
with c as (select distinct stop_id, route_id from v_stop_times join v_trips using (trip_id))
select stop_id, route_id from c union
select parent_station, route_id from c join v_stops using (stop_id) where parent_station is not null""",
    "v_trips_today": """
select * from v_trips where service_id in (select service_id from v_service_days where service_date = DATE '1998-06-15')""",
    "v_departures": """
select station_id, s.trip_id, route_id, direction_id, headsign,
 cast(epoch(timezone('Australia/Melbourne', TIMESTAMP '1998-06-15 12:00:00')) as bigint) - 43200
  + coalesce(dep_s, arr_s) as scheduled_s, s.stop_id
from v_stop_times s join v_trips_today t on s.trip_id = t.trip_id join v_platforms p on p.stop_id = s.stop_id
where cast(epoch(timezone('Australia/Melbourne', TIMESTAMP '1998-06-15 12:00:00')) as bigint) - 43200
  + coalesce(dep_s, arr_s) > epoch(TIMESTAMP '1998-06-15 02:00:00')""",
    "v_top_departures": """
select * from v_departures qualify row_number() over
 (partition by station_id, direction_id order by scheduled_s, trip_id, stop_id) <= 3""",
    "v_added": """
select station_id, trip_id, route_id, cast(null as integer) as direction_id,
 coalesce((select max(name) from v_stops f where f.stop_id = final_stop), final_stop, 'Extra service') as headsign,
 scheduled_s, stop_id
from (select p.station_id, u.trip_id, u.route_id, u.stop_id, coalesce(u.dep_time, u.arr_time) as scheduled_s,
  (select stop_id from v_latest_stus l where l.trip_id = u.trip_id and idx = 2) as final_stop
 from v_latest_stus u join v_platforms p on p.stop_id = u.stop_id
 where relationship = 'ADDED' and route_id is not null
 qualify row_number() over (partition by p.station_id, u.trip_id order by idx) = 1)
where scheduled_s > 0
qualify row_number() over (partition by station_id order by scheduled_s, trip_id) <= 3""",
    "v_overlay": """
select d.*, coalesce(u.dep_time, u.arr_time, d.scheduled_s + coalesce(u.dep_delay, u.arr_delay)) as predicted_s,
 coalesce(u.dep_delay, u.arr_delay) as delay_seconds,
 coalesce(u.dep_time, u.arr_time, u.dep_delay, u.arr_delay) is not null as is_live,
 coalesce(l.relationship = 'CANCELED', false) or coalesce(u.stu_relationship = 'SKIPPED', false) as is_cancelled,
 coalesce(l.relationship = 'ADDED', false) as is_added, s.platform_code
from v_departures d left join v_latest_snaps l on l.trip_id = d.trip_id
 left join (select * from v_latest_stus qualify row_number() over (partition by trip_id, stop_id order by idx) = 1) u
  on u.trip_id = d.trip_id and u.stop_id = d.stop_id
 left join v_stops s on s.stop_id = d.stop_id""",
    "v_rep_trips": """
select route_id, trip_id, shape_id, n as n_stops from
 (select t.*, count(*) as n from v_trips t join v_stop_times s on s.trip_id = t.trip_id
  where not ends_with(route_id, '-R:') group by all)
qualify row_number() over (partition by route_id order by n desc, trip_no) = 1""",
    "v_route_stations": """
select route_id, stop_sequence, x.station_id, replace(s.name, ' Railway Station', '') as station_name, s.lat, s.lon,
 s.stop_id is null as is_dangling
from (select r.route_id, st.stop_sequence, coalesce(p.parent_station, st.stop_id) as station_id,
  lag(coalesce(p.parent_station, st.stop_id)) over (partition by r.route_id order by st.stop_sequence) as before
 from v_rep_trips r join v_stop_times st on st.trip_id = r.trip_id
 left join v_stops p on p.stop_id = st.stop_id and p.location_type <> 1) x
left join v_stops s on s.stop_id = x.station_id and s.location_type = 1
where before is distinct from x.station_id""",
    "v_line_days": """
with f as (select f.*, coalesce(r.short_name = 'Replacement Bus', false) as is_bus
  from v_first_completions f left join v_routes r using (route_id) where f.route_id is not null),
 g as (select service_date, route_id, is_bus,
  count(*) filter (status = 'on_time') as on_time_count, count(*) filter (status = 'late') as late_count,
  count(*) filter (status = 'cancelled') as cancelled_count,
  count(*) filter (status = 'undetermined_gap') as gap_count, count(*) as n from f group by all)
select a.service_date, a.route_id, a.on_time_count, a.late_count, a.cancelled_count, a.gap_count,
 coalesce(b.n, 0) as replacement_bus_count
from g a left join g b on b.service_date = a.service_date
 and b.route_id = regexp_replace(a.route_id, ':+$', '')||'-R:'
where not a.is_bus""",
    "v_hour_days": """
select service_date, f.route_id, cast(hour(timezone('Australia/Melbourne', timezone('UTC', actual_at))) as bigint)
  as hour_local, count(*) as completion_count
from v_first_completions f left join v_routes r using (route_id)
where f.route_id is not null and actual_at is not null and coalesce(r.short_name <> 'Replacement Bus', true)
group by grouping sets ((service_date, f.route_id, hour_local), (service_date, hour_local))""",
    "v_histogram_days": """
select d.service_date,
 count(*) filter (ok and status = 'on_time') as on_time_count,
 count(*) filter (ok and status = 'late' and coalesce(delay_seconds, 0) < 600) as late_5_10_count,
 count(*) filter (ok and status = 'late' and coalesce(delay_seconds, 0) >= 600) as late_10_plus_count,
 count(*) filter (ok and status = 'cancelled') as cancelled_count,
 count(*) filter (ok and status = 'undetermined_gap') as gap_count
from (select f.*, f.route_id is not null and coalesce(r.short_name <> 'Replacement Bus', true) as ok
 from v_first_completions f left join v_routes r using (route_id)) d group by all""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def _needed(sql: str, ordered: list[str]) -> list[str]:
    """Views a statement uses, dependencies first."""
    for name in sorted(set(_NAME.findall(sql)) & VIEWS.keys()):
        if name not in ordered:
            _needed(VIEWS[name], ordered)
            ordered.append(name)
    return ordered


def _quoted(sql: str) -> str:
    """The column name ``at`` is a reserved word in SQL."""
    return re.sub(r"""(?<!["'])\bat\b(?!["'])""", '"at"', sql)


def with_views(sql: str) -> str:
    """Prefix a statement with the canonical views it uses."""
    used, body = _needed(sql, []), _quoted(sql.strip())
    if not used:
        return body
    ctes = ",\n".join(f"{name} as materialized ({_quoted(VIEWS[name].strip())})" for name in used)
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"with {ctes}\n{body}"
