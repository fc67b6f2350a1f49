from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from signalbox.functions import geo
from signalbox.functions import gtfstime as gt
from signalbox.functions import punctuality as pu

UTC = timezone.utc


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,want", [
    ("00:00:00", 0), ("25:10:05", 90605), (" 7:05:09 ", 25509), ("123:00:00", 442800), ("7:60:00", None), ("noon", None), ("", None)])
def test_gtfs_seconds(spark, text, want):
    assert one(spark, gt.gtfs_seconds(F.lit(text))) == want


def test_gtfs_seconds_strict(spark):
    with pytest.raises(Exception, match="hours:minutes:seconds"):
        one(spark, gt.gtfs_seconds(F.lit("x"), strict=True))
    assert one(spark, gt.gtfs_seconds(F.lit(None).cast("string"), strict=True)) is None


@pytest.mark.parametrize("day,start", [
    (date(2026, 4, 5), datetime(2026, 4, 4, 14)),  # clocks go back: noon is already standard time
    (date(2026, 10, 4), datetime(2026, 10, 3, 13)),  # clocks go forward
    (date(2026, 7, 1), datetime(2026, 6, 30, 14)),
])
def test_service_day_start(spark, day, start):
    got = one(spark, F.unix_timestamp(gt.service_day_start(F.lit(day))))
    assert got == int(start.replace(tzinfo=UTC).timestamp())


@pytest.mark.parametrize("at,day", [
    (datetime(2026, 7, 1, 16, 59, 59, tzinfo=UTC), date(2026, 7, 1)), (datetime(2026, 7, 1, 17, 0, tzinfo=UTC), date(2026, 7, 2))])
def test_service_date_turns_at_three(spark, at, day):
    assert one(spark, gt.service_date(F.lit(at))) == day
    assert gt.service_date_of(at) == day


def test_boundary_inverts_service_date(spark):
    edge = one(spark, F.unix_timestamp(gt.service_date_boundary(F.lit(date(2026, 4, 5)))))
    at = lambda s: one(spark, gt.service_date(F.timestamp_seconds(F.lit(s))))
    assert at(edge) == date(2026, 4, 5) and at(edge - 1) == date(2026, 4, 4)


@pytest.mark.parametrize("text,want", [("20260801", date(2026, 8, 1)), ("2026X801", None), ("20261399", None), ("2026", None)])
def test_start_date(spark, text, want):
    assert one(spark, gt.parse_start_date(F.lit(text))) == want


@pytest.mark.parametrize("hour,band", [(0, "overnight"), (7, "am_peak"), (9, "midday"), (16, "pm_peak"), (18, "evening"), (23, "evening")])
def test_time_band(spark, hour, band):
    assert one(spark, gt.time_band(F.lit(hour))) == band


def test_ranges():
    now = datetime(2026, 7, 10, 1, 0, tzinfo=UTC)  # local 11:00 on the 10th
    assert gt.resolve_range("today", now) == ([date(2026, 7, 10)], 1)
    assert gt.resolve_range("yesterday", now) == ([date(2026, 7, 9)], 1)
    days, expected = gt.resolve_range("last7", now)
    assert (days[0], days[-1], expected) == (date(2026, 7, 4), date(2026, 7, 10), 7)
    days, expected = gt.resolve_range("custom", now, date(2026, 7, 8), date(2026, 7, 20))
    assert (days[-1], expected) == (date(2026, 7, 10), 13)
    assert gt.resolve_range("custom", now, date(2026, 8, 1), date(2026, 8, 2)) == ([], 2)
    for bad in (("custom", None, None), ("custom", date(2026, 7, 2), date(2026, 7, 1)), ("ever", None, None)):
        with pytest.raises(gt.RangeError):
            gt.resolve_range(bad[0], now, *bad[1:])


@pytest.mark.parametrize("at,monday", [
    (datetime(2026, 7, 5, 21, 59, tzinfo=UTC), date(2026, 6, 29)), (datetime(2026, 7, 5, 22, 0, tzinfo=UTC), date(2026, 7, 6))])
def test_week_boundary_at_eight(spark, at, monday):
    from signalbox.streaming.jobs import last_boundary
    assert one(spark, gt.latest_week_boundary(F.lit(at))) == monday
    assert last_boundary(at) == monday


def test_haversine_and_box(spark):
    d = one(spark, geo.haversine_m(F.lit(-37.8), F.lit(144.9), F.lit(-37.8), F.lit(144.91)))
    assert d == pytest.approx(878.6, abs=0.5)
    assert one(spark, geo.in_box(F.lit(-37.815), F.lit(144.975)))
    assert one(spark, geo.loop_contained(F.lit(-37.81), F.lit(144.97), F.lit(None).cast("double"), F.lit(1.0))) is False


def test_punctuality(spark):
    status = lambda d: one(spark, pu.punctuality_status(F.lit(d).cast("int")))
    assert [status(d) for d in (-500, 299, 300, None)] == ["on_time", "on_time", "late", None]
    assert one(spark, pu.percent_on_time(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, pu.replacement_route_id(F.lit("2-ABC::"))) == "2-ABC-R:"
    actual, plan = F.timestamp_millis(F.lit(10_900)), F.timestamp_seconds(F.lit(12))
    assert one(spark, pu.terminus_delay(F.lit(None).cast("int"), actual, plan)) == -1  # cut toward zero


@pytest.mark.parametrize("args,label", [
    ((True, True, True, 0), "Cancelled"), ((False, True, True, 500), "Extra service"), ((False, False, False, 500), "Scheduled"),
    ((False, False, True, 60), "On time"), ((False, False, True, None), "On time"), ((False, False, True, 90), "+2 min"),
    ((False, False, True, -90), "-1 min early")])
def test_badge(spark, args, label):
    c, a, live, d = args
    assert one(spark, pu.schedule_badge(F.lit(c), F.lit(a), F.lit(live), F.lit(d).cast("int"))) == label
