"""Queries over completion events: rollups, ranges, weekly digests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from signalbox.functions import gtfstime as gt
from signalbox.functions import punctuality as pu
from signalbox.operators import rollups as ro
from signalbox.plans.canonical import SCHEDULE_NOW, Tables, epoch
from signalbox.plans.registry import query

# the whole stored history up to the request instant
RANGE, EXPECTED = gt.resolve_range("custom", SCHEDULE_NOW, date(1995, 1, 1), date(2001, 12, 31))
IN_RANGE = "service_date between DATE '1995-01-01' and DATE '1998-06-15'"


def _first(t: Tables):
    return ro.first_completions(t.completions, ["seq"])


def _lines(t: Tables):
    return ro.line_day_rollup(_first(t), t.routes)


def _hours(t: Tables):
    return ro.hour_day_rollup(_first(t), t.routes)


@query("win01_first_completion", """
select strftime(service_date, '%Y-%m-%d') as service_date, trip_id, route_id, status,
 cast(delay_seconds as bigint) as delay_seconds, cast(seq as bigint) as seq from v_first_completions""")
def _(t):
    return _first(t).select(
        F.col("service_date").cast("string").alias("service_date"), "trip_id", "route_id", "status",
        F.col("delay_seconds").cast("bigint").alias("delay_seconds"), F.col("seq").cast("bigint").alias("seq"))


@query("agg03_line_day_rollup", """
select strftime(service_date, '%Y-%m-%d') as service_date, route_id, on_time_count, late_count, cancelled_count,
 gap_count, replacement_bus_count from v_line_days""")
def _(t):
    return _lines(t).withColumn("service_date", F.col("service_date").cast("string"))


@query("agg04_hour_day_rollup", """
select strftime(service_date, '%Y-%m-%d') as service_date, route_id, hour_local, completion_count from v_hour_days""")
def _(t):
    return _hours(t).withColumn("service_date", F.col("service_date").cast("string"))


@query("agg05_delay_histogram", """
select strftime(service_date, '%Y-%m-%d') as service_date, on_time_count, late_5_10_count, late_10_plus_count,
 cancelled_count, gap_count from v_histogram_days""")
def _(t):
    return ro.histogram_day_rollup(_first(t), t.routes).withColumn("service_date", F.col("service_date").cast("string"))


@query("agg06_range_sum_by_line", f"""
select route_id, cast(sum(on_time_count) as bigint) as on_time_count, cast(sum(late_count) as bigint) as late_count,
 cast(sum(cancelled_count) as bigint) as cancelled_count, cast(sum(gap_count) as bigint) as gap_count,
 cast(sum(replacement_bus_count) as bigint) as replacement_bus_count
from v_line_days where {IN_RANGE} group by route_id""")
def _(t):
    return ro.sum_lines(_lines(t), RANGE)


@query("agg07_range_sum_by_hour", f"""
select route_id, hour_local, cast(sum(completion_count) as bigint) as completion_count
from v_hour_days where {IN_RANGE} group by all""")
def _(t):
    return ro.sum_hours(_hours(t), RANGE)


@query("agg08_range_histogram", f"""
select cast(coalesce(sum(on_time_count), 0) as bigint) as on_time_count,
 cast(coalesce(sum(late_5_10_count), 0) as bigint) as late_5_10_count,
 cast(coalesce(sum(late_10_plus_count), 0) as bigint) as late_10_plus_count,
 cast(coalesce(sum(cancelled_count), 0) as bigint) as cancelled_count,
 cast(coalesce(sum(gap_count), 0) as bigint) as gap_count from v_histogram_days where {IN_RANGE}""")
def _(t):
    return ro.sum_histogram(ro.histogram_day_rollup(_first(t), t.routes), RANGE)


@query("agg09_range_coverage", """
select strftime(d, '%Y-%m-%d') as service_date, d in (select service_date from v_line_days) as is_covered,
 case when d in (select service_date from v_completions)
  then cast(epoch(cast(d as timestamp)) as bigint) + 100000 end as generated_at
from (select cast(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-06-15', interval 1 day)) as date) as d)""")
def _(t):
    day = F.col("service_date")
    meta = t.completions.select("service_date").distinct().withColumn(
        "generated_at", F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400 + 100000))
    return ro.range_coverage(_lines(t), meta, RANGE).select(
        day.cast("string").alias("service_date"), "is_covered", epoch("generated_at").alias("generated_at"))


_WEEKS = """
select cast(date_trunc('week', service_date) as date) as w, route_id,
 count(*) filter (status = 'on_time') as o, count(*) filter (status = 'late') as l,
 count(*) filter (status = 'cancelled') as c from v_completions group by all"""


@query("agg10_weekly_network_stats", f"""
with x as ({_WEEKS})
select strftime(w, '%Y-%m-%d') as week_start, strftime(w + 6, '%Y-%m-%d') as week_end,
 (select count(distinct service_date) from v_completions f where date_trunc('week', f.service_date) = w) as days_covered,
 cast(sum(o) as bigint) as on_time_count, cast(sum(l) as bigint) as late_count,
 cast(sum(c) as bigint) as cancelled_count,
 case when sum(o) + sum(l) > 0 then round(100.0 * sum(o) / (sum(o) + sum(l)), 6) else 0.0::double end::double as on_time_pct
from x group by w""")
def _(t):
    return ro.weekly_network_stats(t.completions).select(
        F.col("week_start").cast("string").alias("week_start"), F.col("week_end").cast("string").alias("week_end"),
        "days_covered", "on_time_count", "late_count", "cancelled_count",
        F.round("on_time_pct", 6).alias("on_time_pct"))


_WEEK_LINES = f"""
select strftime(w, '%Y-%m-%d') as week_start, route_id, o + l as trip_count, o as on_time_count, l as late_count,
 c as cancelled_count, round(100.0::double * o / (o + l), 6) as on_time_pct
from ({_WEEKS}) where route_id is not null and o + l >= 3"""


@query("agg10_weekly_line_stats", _WEEK_LINES)
def _(t):
    return ro.weekly_line_stats(t.completions, min_sample=3).select(
        F.col("week_start").cast("string").alias("week_start"), "route_id", "trip_count", "on_time_count",
        "late_count", "cancelled_count", F.round("on_time_pct", 6).alias("on_time_pct"))


@query("sort02_latest_digests", f"""
with x as ({_WEEKS}), n as (select w from x group by w order by w desc limit 20)
select strftime(n.w, '%Y-%m-%d') as week_start, x.route_id, x.o + x.l as trip_count,
 round(100.0::double * o / (o + l), 6) as line_on_time_pct
from n left join x on x.w = n.w and x.route_id is not null and o + l >= 3""")
def _(t):
    stats = ro.weekly_line_stats(t.completions, min_sample=3)
    return ro.latest_digests(ro.weekly_network_stats(t.completions), stats).select(
        F.col("week_start").cast("string").alias("week_start"), "route_id", "trip_count",
        F.round("line_on_time_pct", 6).alias("line_on_time_pct"))


@query("sort04_lines_by_on_time", f"""
select week_start, route_id, on_time_pct,
 row_number() over (partition by week_start order by on_time_pct desc, route_id) as place from ({_WEEK_LINES})""")
def _(t):
    from pyspark.sql import Window
    w = Window.partitionBy("week_start").orderBy(F.desc("on_time_pct"), "route_id")
    stats = ro.weekly_line_stats(t.completions, min_sample=3).withColumn("on_time_pct", F.round("on_time_pct", 6))
    return stats.select(F.col("week_start").cast("string").alias("week_start"), "route_id", "on_time_pct",
                        F.row_number().over(w).cast("bigint").alias("place"))


@query("agg11_network_kpi", """
select round(100.0::double * sum(on_time_count) / sum(on_time_count + late_count), 6) as on_time_pct,
 cast(sum(on_time_count + late_count + cancelled_count + gap_count) as bigint) as total,
 cast(sum(cancelled_count) as bigint) as cancelled, cast(sum(gap_count) as bigint) as gap from v_line_days""")
def _(t):
    return ro.network_kpi(_lines(t)).withColumn("on_time_pct", F.round("on_time_pct", 6))


_SERIES = """
select d as service_date, cast(coalesce(sum(on_time_count), 0) as bigint) as on_time_count,
 cast(coalesce(sum(late_count), 0) as bigint) as late_count,
 cast(coalesce(sum(cancelled_count), 0) as bigint) as cancelled_count,
 cast(coalesce(sum(gap_count), 0) as bigint) as gap_count, count(route_id) > 0 as has_data
from (select cast(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-06-15', interval 1 day)) as date) as d)
 left join v_line_days on service_date = d group by d"""


@query("win14_daily_series", f"select * replace (strftime(service_date, '%Y-%m-%d') as service_date) from ({_SERIES})")
def _(t):
    return ro.daily_series(_lines(t), RANGE).withColumn("service_date", F.col("service_date").cast("string"))


@query("agg12_weekday_weekend", f"""
select case when isodow(service_date) >= 6 then 'weekend' else 'weekday' end as day_type,
 cast(sum(on_time_count) as bigint) as on_time_count, cast(sum(on_time_count + late_count) as bigint) as ran,
 round(100.0::double * sum(on_time_count) / sum(on_time_count + late_count), 6) as on_time_pct,
 sum(on_time_count + late_count) > 0 as has_data from ({_SERIES}) group by 1""")
def _(t):
    return ro.weekday_weekend(ro.daily_series(_lines(t), RANGE)).withColumn("on_time_pct", F.round("on_time_pct", 6))


@query("win15_hour_series", f"""
select h as hour_local, cast(coalesce(sum(completion_count), 0) as bigint) as completion_count
from (select unnest(generate_series(0, 23)) as h)
left join (select * from v_hour_days where {IN_RANGE} and route_id is null) on hour_local = h group by h""")
def _(t):
    return ro.hour_series(ro.sum_hours(_hours(t), RANGE))


@query("win16_busiest_lines", f"""
select route_id, cast(sum(on_time_count + late_count) as bigint) as ran, sum(on_time_count + late_count) < 20 as low_sample
from v_line_days where {IN_RANGE} group by route_id""")
def _(t):
    return ro.busiest_lines(ro.sum_lines(_lines(t), RANGE))


@query("flt04_real_line_filter", """
select c.route_id, c.status, count(*) as n from v_completions c left join v_routes r using (route_id)
where c.route_id is not null and coalesce(r.short_name <> 'Replacement Bus', true) group by all""")
def _(t):
    return ro.real_line_events(t.completions, t.routes).groupBy("route_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("flt10_labelable_completions", """
select status, count(*) as n, cast(sum(delay_seconds) as bigint) as total_delay from v_completions
where status not in ('cancelled', 'undetermined_gap') and delay_seconds is not null group by status""")
def _(t):
    from signalbox.operators.model import labelable
    return labelable(t.completions).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("delay_seconds").alias("total_delay"))


@query("flt13_digest_has_data", f"""
with x as ({_WEEKS})
select strftime(w, '%Y-%m-%d') as week_start, route_id, o + l > 0 as has_data,
 case when o + l > 0 then round(100.0::double * o / (o + l), 6) end as shown_pct from x where route_id is not null""")
def _(t):
    stats = ro.weekly_line_stats(t.completions, min_sample=0)
    has = pu.has_digest_data(F.col("on_time_count"), F.col("late_count"))
    return stats.select(F.col("week_start").cast("string").alias("week_start"), "route_id", has.alias("has_data"),
                        F.when(has, F.round("on_time_pct", 6)).alias("shown_pct"))


@query("scl17_punctuality_status", """
select case when delay_seconds <= 299 then 'on_time' when delay_seconds is not null then 'late' end as status,
 count(*) as n, cast(min(delay_seconds) as bigint) as lowest, cast(max(delay_seconds) as bigint) as highest
from v_completions group by 1""")
def _(t):
    return t.completions.groupBy(pu.punctuality_status("delay_seconds").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.min("delay_seconds").cast("bigint").alias("lowest"),
        F.max("delay_seconds").cast("bigint").alias("highest"))


@query("scl18_terminus_delay", """
select service_date_s as service_date, count(*) as n, cast(sum(d) as bigint) as total, min(d) as lowest, max(d) as highest
from (select strftime(service_date, '%Y-%m-%d') as service_date_s,
  coalesce(case when seq % 3 <> 0 then delay_seconds end,
   cast(epoch(actual_at - cast(service_date as timestamp)) as bigint) - 43200 ) as d from v_completions) group by 1""")
def _(t):
    noon = F.timestamp_seconds(F.unix_date("service_date").cast("bigint") * 86400 + 43200)
    delay = pu.terminus_delay(F.when(F.col("seq") % 3 != 0, F.col("delay_seconds")), F.col("actual_at"), noon)
    return t.completions.select(F.col("service_date").cast("string").alias("service_date"), delay.cast("bigint").alias("d")) \
        .groupBy("service_date").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total"),
                                     F.min("d").alias("lowest"), F.max("d").alias("highest"))


@query("scl19_on_time_pct", """
select route_id, case when count(*) filter (status in ('on_time', 'late')) > 0 then
 round(100.0::double * count(*) filter (status = 'on_time') / count(*) filter (status in ('on_time', 'late')), 6)
 else 0.0::double end as on_time_pct from v_completions group by route_id""")
def _(t):
    counts = t.completions.groupBy("route_id").agg(
        F.count_if(F.col("status") == "on_time").alias("o"), F.count_if(F.col("status") == "late").alias("l"))
    return counts.select("route_id", F.round(pu.percent_on_time(F.col("o"), F.col("l")), 6).alias("on_time_pct"))


@query("scl04_service_date_of_instant", """
select strftime(cast(l as date) - case when hour(l) < 3 then 1 else 0 end, '%Y-%m-%d') as service_date, count(*) as n
from (select timezone('Australia/Melbourne', timezone('UTC', ts)) as l from v_events) group by 1""")
def _(t):
    return t.polls.groupBy(gt.service_date(F.timestamp_micros("ts_us")).cast("string").alias("service_date")).agg(
        F.count(F.lit(1)).alias("n"))


@query("scl09_week_boundary", """
select strftime(m - case when cast(l as date) = m and hour(l) < 8 then 7 else 0 end, '%Y-%m-%d') as fired_on, count(*) as n
from (select l, cast(date_trunc('week', l) as date) as m from
 (select timezone('Australia/Melbourne', timezone('UTC', ts)) as l from v_events)) group by 1""")
def _(t):
    return t.polls.groupBy(gt.latest_week_boundary(F.timestamp_micros("ts_us")).cast("string").alias("fired_on")).agg(
        F.count(F.lit(1)).alias("n"))


@query("scl08_resolve_range", """
select 'last30' as range_name, 30 as expected_days, count(distinct service_date) as days_present, count(*) as n
from v_completions where service_date between DATE '1998-05-17' and DATE '1998-06-15'
union all select 'last7', 7, count(distinct service_date), count(*) from v_completions
 where service_date between DATE '1998-06-09' and DATE '1998-06-15'
union all select 'yesterday', 1, count(distinct service_date), count(*) from v_completions
 where service_date = DATE '1998-06-14'
union all select 'today', 1, count(distinct service_date), count(*) from v_completions
 where service_date = DATE '1998-06-15'""")
def _(t):
    parts = None
    for name in ("last30", "last7", "yesterday", "today"):
        days, expected = gt.resolve_range(name, SCHEDULE_NOW)
        one = ro.in_days(t.completions, days).groupBy("service_date").agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(name).alias("range_name"), F.lit(expected).alias("expected_days"),
            F.count(F.lit(1)).alias("days_present"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    return parts
