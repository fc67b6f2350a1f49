from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from signalbox.operators import schedule as sc
from tests.conftest import rows

CAL = "service_id string, monday boolean, tuesday boolean, wednesday boolean, thursday boolean, friday boolean, saturday boolean, sunday boolean, start_date date, end_date date"
YEAR = (date(2026, 1, 1), date(2026, 12, 31))


@pytest.fixture(scope="module")
def net(spark):
    week = [("WK", True, True, True, True, True, False, False, *YEAR), ("WE", False, False, False, False, False, True, True, *YEAR)]
    make = spark.createDataFrame
    return dict(
        calendar=make(week, CAL),
        dates=make([("WK", date(2026, 4, 6), 2), ("WE", date(2026, 4, 6), 1)], "service_id string, date date, exception_type int"),
        routes=make([("A:", "Alpha", "Alpha Line"), ("A-R:", "Replacement Bus", "Alpha Line"), ("B:", "Beta", "Beta Line")],
                    "route_id string, short_name string, long_name string"),
        trips=make([("t1", "A:", "WK", 0, "North", "s1"), ("t2", "A:", "WK", 1, "", None), ("t3", "B:", "WE", None, "East", None),
                    ("t4", "A:", "WK", 0, "North", None)],
                   "trip_id string, route_id string, service_id string, direction_id int, headsign string, shape_id string"),
        stops=make([("P1", None, 1, "One Railway Station", -37.8, 144.9, None), ("1a", "P1", 0, "One a", -37.8, 144.9, "1"),
                    ("2", None, 0, "Two", -37.9, 144.9, None), ("3", None, 0, "Three", -37.95, 144.95, None)],
                   "stop_id string, parent_station string, location_type int, name string, lat double, lon double, platform_code string"),
        times=make([("t1", 1, "1a", "08:00:00", "08:01:00"), ("t1", 2, "2", "08:10:00", None), ("t2", 1, "2", "09:00:00", "09:00:00"),
                    ("t2", 2, "1a", "25:00:00", None), ("t3", 1, "3", "10:00:00", "10:00:00"), ("t4", 1, "1a", None, "08:30:00"),
                    ("t4", 2, "3", "08:40:00", "08:41:00"), ("t4", 3, "2", "08:50:00", None)],
                   "trip_id string, stop_sequence long, stop_id string, arrival_time string, departure_time string"),
    )


def active(spark, net, day):
    return {r[1] for r in rows(sc.active_services(net["calendar"], net["dates"], sc.one_day(spark, day)))}


def test_calendar(spark, net):
    assert active(spark, net, date(2026, 4, 3)) == {"WK"}
    assert active(spark, net, date(2026, 4, 4)) == {"WE"}
    assert active(spark, net, date(2026, 4, 6)) == {"WE"}  # a Monday run as a weekend
    assert active(spark, net, date(2027, 1, 4)) == set()


def test_platforms_and_routes(net):
    assert ("P1", "1a") in rows(sc.station_platforms(net["stops"])) and ("2", "2") in rows(sc.station_platforms(net["stops"]))
    assert rows(sc.stop_routes(net["times"], net["trips"], net["stops"])) == [
        ("1a", "A:"), ("2", "A:"), ("3", "A:"), ("3", "B:"), ("P1", "A:")]


def test_departures(spark, net):
    day = date(2026, 7, 1)
    today = sc.trips_on(net["trips"], sc.active_services(net["calendar"], net["dates"], sc.one_day(spark, day)))
    now = F.lit(datetime(2026, 6, 30, 22, 1, tzinfo=timezone.utc))  # 08:01 local: strictly later calls only
    got = sc.scheduled_departures(net["times"], today, net["stops"], day, now)
    assert rows(got.filter("station_id = 'P1'"), "trip_id", "direction_id") == [("t2", 1), ("t4", 0)]
    assert rows(sc.top_per_direction(got, 1).filter("station_id = '2'"), "trip_id") == [("t1",), ("t2",)]
    soon = sc.soonest_per_direction(got).filter("station_id = '2'")
    assert rows(soon, "heading", "trip_id") == [("0", "t1"), ("1", "t2")]


def test_departure_times_are_parsed_once(spark, net):
    """A filter on the parsed time holds the expression behind the text once, however long it is."""
    padded = net["times"].withColumn("departure_time", F.concat(F.lit(" "), "departure_time"))
    now = F.lit(datetime(2026, 6, 30, 22, 1, tzinfo=timezone.utc))
    got, want = (sc.scheduled_departures(t, net["trips"], net["stops"], date(2026, 7, 1), now) for t in (padded, net["times"]))
    assert rows(got) == rows(want) and got.count() > 0
    filters = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and all(line.count("concat(") <= 1 for line in filters)


def test_termini_work_out_what_is_asked_for(net):
    """The stop number alone needs neither the stop nor its times."""
    plan = sc.trip_termini(net["times"]).select("trip_id", "terminus_sequence")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "max(" in plan


def test_added_and_overlay(spark, net):
    stu = "array<struct<stop_id: string, relationship: string, arr_time: string, dep_time: string, arr_delay: int, dep_delay: int>>"
    snaps = spark.createDataFrame(
        [("x1", "B:", "ADDED", [("1a", None, "100", None, None, None), ("2", None, "200", None, None, None)]),
         ("x2", None, "ADDED", [("1a", None, "100", None, None, None)]),
         ("t1", "A:", "SCHEDULED", [("1a", "SKIPPED", None, None, 30, None)])],
        f"trip_id string, route_id string, relationship string, stop_time_updates {stu}")
    added = sc.added_departures(snaps, net["stops"], F.timestamp_seconds(F.lit(50)))
    assert rows(added.filter("station_id = 'P1'"), "trip_id", "headsign") == [("x1", "Two")]
    dep = spark.createDataFrame([("P1", "t1", "1a"), ("P1", "t9", "1a")], "station_id string, trip_id string, stop_id string").withColumn(
        "scheduled_at", F.timestamp_seconds(F.lit(1000)))
    live = sc.live_overlay(dep, snaps, net["stops"]).withColumn("p", F.unix_timestamp("predicted_at"))
    assert rows(live, "trip_id", "p", "delay_seconds", "is_live", "is_cancelled") == [
        ("t1", 1030, 30, True, True), ("t9", None, None, False, False)]


def test_lookup(net):
    assert rows(sc.routes_by_name(net["routes"], " ALPHA "), "route_id") == [("A:",)]
    assert rows(sc.routes_by_name(net["routes"], "ta"), "route_id") == [("B:",)]
    assert rows(sc.routes_by_name(net["routes"], "  "), "route_id") == [] == rows(sc.routes_by_name(net["routes"], "bus"), "route_id")


def test_votes(spark, net):
    stop_route = spark.createDataFrame([("1", "A:"), ("2", "A:"), ("2", "A-R:"), ("3", "B:"), ("2", "B:")], "stop_id string, route_id string")
    listed = spark.createDataFrame(
        [("tie", 0, "1"), ("tie", 1, "3"), ("win", 0, "1"), ("win", 1, "2"), ("half", 0, "1"), ("half", 1, "9"), ("none", 0, "9")],
        "alert_id string, ordinal int, stop_id string")
    assert rows(sc.likely_lines(listed, stop_route, net["routes"]), "alert_id", "long_name") == [("win", "Alpha Line")]


def test_skip_counts(spark):
    make = spark.createDataFrame
    patterns = {"a": "ABCD", "b": "ABCD", "c": "ACD", "d": "AD", "lone": "AE", "bus": "ABCD"}
    trips = make([(t, "X:" if t != "bus" else "X-R:", 0) for t in patterns], "trip_id string, route_id string, direction_id int")
    times = make([(t, i * 3, s) for t, p in patterns.items() for i, s in enumerate(p)], "trip_id string, stop_sequence long, stop_id string")
    stops = make([(s, None) for s in "ABCDE"], "stop_id string, parent_station string")
    routes = make([("X:", "X"), ("X-R:", "Replacement Bus")], "route_id string, short_name string")
    got = sc.skip_stop_counts(trips, times, stops, routes)
    assert rows(got) == [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("lone", None)]


def test_no_service_and_geometry(spark, net):
    calls = sc.stop_routes(net["times"], net["trips"], net["stops"])
    idle = sc.lines_without_service(calls, net["stops"], net["routes"], net["trips"].filter("service_id = 'WK'"))
    assert rows(idle, "station_id", "route_id") == [("3", "B:")]
    reps = sc.representative_trips(net["trips"].withColumn("n", F.substring("trip_id", 2, 1)), net["times"], tie="n")
    assert rows(reps, "route_id", "trip_id") == [("A:", "t4"), ("B:", "t3")]
    placed = sc.route_stations(reps, net["times"], net["stops"])
    assert [r[1] for r in rows(placed.filter("route_id = 'A:'"), "stop_sequence", "station_id")] == ["P1", "3", "2"]


def test_churn_and_pins(spark):
    ids = lambda *t: spark.createDataFrame([(x,) for x in t], "trip_id string")
    assert sc.trip_id_churn(ids("a", "b"), ids("b", "c")).first().stable_pct == 50.0
    assert sc.trip_id_churn(ids(), ids("b")).first().stable_pct == 100.0
    pins = spark.createDataFrame([(date(2026, 1, 1), "d1")], "service_date date, digest string")
    assert sc.pinned_digest(pins, date(2026, 1, 1)) == "d1"
    with pytest.raises(sc.UnpinnedError):
        sc.pinned_digest(pins, date(2026, 1, 2))
