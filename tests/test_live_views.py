"""Views over the latest merged cycle, also on other dates than the driver's."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
@pytest.mark.parametrize("name", ["join25_current_trains", "join27_trip_details"])
def test_live_trips_are_those_of_the_latest_cycle(spark, name):
    from signalbox.plans.canonical import Tables
    from signalbox.plans.feed_queries import merged

    cycles = [(r.cycle, r.trip_id) for r in merged(Tables(spark, SF)).select("cycle", "trip_id").collect()]
    last = max(c for c, _ in cycles)
    latest = {t for c, t in cycles if c == last}
    got = entry.queries()[name](spark, SF)
    live = "position_source = 'live'" if name.startswith("join27") else "route_id is not null"
    found = {r.trip_id for r in got.filter(live).select("trip_id").collect()}
    assert found <= latest and (found == latest if name.startswith("join27") else "skipped_stop_count" in got.columns)
    good, message = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF, connect(SF))
    assert good, message
