import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from signalbox.operators import alerts as al
from signalbox.operators import feeds as fd
from signalbox.operators import quality as qu
from signalbox.operators import station as st
from signalbox.schemas import CAPTURE
from signalbox.sources import captures as cp
from tests.conftest import rows


def poll(second, *entities, header="1000"):
    stamp = datetime.fromtimestamp(second, timezone.utc).isoformat()
    return {"fetch_timestamp": stamp, "feed": {"header": {"timestamp": header}, "entity": list(entities)}}


def tu(trip, route="R1", **trip_fields):
    return {"id": "x", "trip_update": {"trip": {"trip_id": trip, "route_id": route, **trip_fields}, "stop_time_update": [
        {"stop_sequence": 1, "stop_id": "S", "arrival": {"delay": 5, "time": "1700000000"}}]}}


def vp(trip, stamp="990", **fields):
    return {"id": "y", "vehicle": {"trip": {"trip_id": trip, **fields}, "position": {"latitude": -37.8, "longitude": 144.9}, "timestamp": stamp}}


@pytest.fixture
def captures(spark, tmp_path):
    def make(*polls):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.ndjson"
        path.write_text("\n\n".join(json.dumps(p) for p in polls))
        return cp.read_captures(spark, str(path))
    return make


def test_missing_capture_is_empty(spark, tmp_path):
    assert cp.read_captures(spark, str(tmp_path / "nothing.ndjson")).count() == 0


def test_flatten_last_entity_wins(captures):
    got = fd.trip_updates(captures(poll(0, tu("a", "R1"), tu("a", "R2"), tu(None), vp("a"))))
    assert rows(got, "trip_id", "route_id") == [("a", "R2")]
    update = got.first().stop_time_updates[0]
    assert (update.arr_time, update.dep_time, update.arr_delay) == ("1700000000", None, 5)


def test_vehicle_time_falls_back_to_header(captures):
    got = fd.vehicle_positions(captures(poll(0, vp("a"), vp("b", None), header="1234")))
    assert rows(got, "trip_id", F.unix_timestamp("position_updated_at")) == [("a", 990), ("b", 1234)]


def merged(captures, tus, vps):
    return fd.merge_feeds(fd.trip_updates(captures(poll(0, *tus))), fd.vehicle_positions(captures(poll(0, *vps))))


def test_merge_and_discrepancies(captures):
    m = merged(captures, [tu("a"), tu("b", start_time="08:00:00", schedule_relationship="SCHEDULED")],
               [vp("b", route_id="R9", start_time="09:00:00", start_date=None), vp("c", route_id="R3")])
    assert rows(m, "trip_id", "route_id", "in_tu", "in_vp") == [("a", "R1", True, False), ("b", "R1", True, True), ("c", None, False, True)]
    assert rows(fd.discrepancies(m), "trip_id", "discrepancy_type", "tu_value", "vp_value") == [
        ("b", "route_id_mismatch", "R1", "R9"), ("b", "start_time_mismatch", "08:00:00", "09:00:00"), ("c", "vp_without_tu", None, "R3")]


def test_header_changes(spark):
    polls = spark.createDataFrame([("v", 1, 10), ("v", 2, 10), ("v", 3, 40), ("v", 4, 30), ("v", 5, None), ("v", 6, None)], "feed string, at long, header long")
    for chunk_s in (2, 3600):
        got = fd.header_changes(polls, "feed", "at", "header", chunk_s=chunk_s)
        assert [(r[1], r[3], r[4]) for r in rows(got)] == [
            (1, True, None), (2, False, None), (3, True, 30), (4, True, -10), (5, True, None), (6, True, None)]
    reused = fd.reused_content(polls, "feed", "at", "header")
    assert [r[1] for r in rows(reused, "at", "content_at")] == [1, 1, 3, 4, 5, 6]


def test_delta(spark):
    make = lambda *r: spark.createDataFrame(list(r), "trip_id string, v int")
    before, after = make(("a", 1), ("b", None), ("c", 3)), make(("a", 2), ("b", None), ("d", 4))
    changed, removed = fd.snapshot_diff(before, after)
    assert (rows(changed), rows(removed)) == ([("a", 2), ("d", 4)], [("c",)])
    assert rows(fd.apply_delta(before, changed, removed)) == rows(after)


def test_publish_changes(spark, tmp_path):
    from signalbox.streaming.jobs import publish_changes
    make = lambda *r: spark.createDataFrame(list(r), "trip_id string, v int")
    base = str(tmp_path / "live")
    assert rows(publish_changes(make(("a", 1), ("b", 2)), base, 0)[0]) == [("a", 1), ("b", 2)]
    changed, removed = publish_changes(make(("a", 1), ("c", 3)), base, 1)
    assert (rows(changed), rows(removed)) == ([("c", 3)], [("b",)])


def test_outages(spark):
    polls = [(0, True, 50), (10, False, None), (20, True, 5), (30, False, None), (40, False, 9), (50, True, None), (60, False, 1)]
    df = spark.createDataFrame(polls, "at long, ok boolean, remaining long")
    got = qu.outage_episodes(df)
    # four bad cycles climb to the cap; the run still open at the end is not reported
    assert rows(got, "started_at", "ended_at", "bad_cycles", "consecutive_failures", "max_level_reached_s") == [(10, 50, 4, 3, 300.0)]


def test_rate_limits(spark):
    df = spark.createDataFrame([(1, '[{"window":"m","remaining":7},{"window":"d","remaining":3}]'), (1, "oops"), (2, None)], "c int, h string")
    assert rows(qu.lowest_remaining_per_cycle(df, "c", "h")) == [(1, 3), (2, None)]


def alert(ident, routes=(), start=None, end=None, lang="en"):
    return {"id": ident, "alert": {"header_text": {"translation": [{"text": "fr", "language": "fr"}, {"text": "hi", "language": lang}]},
            "active_period": [{"start": start, "end": end}] if start or end else [], "informed_entity": [dict(e) for e in routes]}}


@pytest.fixture
def alerts(captures):
    r = lambda **k: k
    return al.alerts_of(captures(poll(
        0, alert("net"), alert("r1", [r(route_id="R1")], "10", "20"), alert("r1s", [r(route_id="R1", stop_id="S")], "15"),
        alert("r2d", [r(route_id="R2", direction_id=1), r(stop_id="S", direction_id=0)], None, "30", lang="de"), {"id": "none"}, alert(None))))


def at(second):
    return F.timestamp_seconds(F.lit(second))


def test_alert_parsing(alerts):
    assert rows(alerts, "id", "header_text") == [("net", "hi"), ("r1", "hi"), ("r1s", "hi"), ("r2d", "fr")]


@pytest.mark.parametrize("second,ids", [(9, ["net", "r2d"]), (10, ["net", "r1", "r2d"]), (20, ["net", "r1", "r1s", "r2d"]), (31, ["net", "r1s"])])
def test_alert_activity_is_inclusive(alerts, second, ids):
    assert [r[0] for r in rows(alerts.filter(al.is_active(at(second))), "id")] == ids


def test_alert_matching_agrees_with_single_requests(spark, alerts):
    requests = [(f"{r}{s}{d}", r, s, d) for r in (None, "R1", "R2") for s in (None, "S", "T") for d in (None, 0, 1)]
    df = spark.createDataFrame(requests, "request_id string, route_id string, stop_id string, direction_id int")
    got = {}
    for req, ident in rows(al.match_alerts(alerts, df, at(18))):
        got.setdefault(req, set()).add(ident)
    for name, r, s, d in requests:
        want = {x[0] for x in rows(al.alerts_matching(alerts, at(18), r, s, d), "id")}
        assert got.get(name, set()) == want, name


def test_newest_first(alerts):
    assert [r.id for r in al.newest_first(alerts).collect()] == ["r1s", "r1", "net", "r2d"]


STU = "array<struct<stop_id: string, stop_sequence: int, arr_time: string, dep_time: string, arr_delay: int, dep_delay: int>>"
WINDOW = [("A", 4, None, "100", 1, 2), ("B", 5, "200", "230", None, 9), ("C", 6, "300", "330", 7, None), ("X", 7, None, None, None, None)]
TERMINUS = [("A", 4, "50", "100", None, None), ("Z", 5, "200", None, None, None)]


@pytest.mark.parametrize("stus,now,state,following,sequence", [
    (WINDOW, 99, ("at", "A", None, None, None), ("A", 1), 3),
    (WINDOW, 150, ("between", None, "A", "B", 0.5), ("B", 9), 4),
    (WINDOW, 230, ("at", "B", None, None, None), ("C", 7), 5),
    (WINDOW, 310, ("unknown", None, None, None, None), (None, None), None),
    (WINDOW, 330, ("between", None, "C", None, None), (None, None), 6),
    (TERMINUS, 40, ("between", None, None, "A", None), ("A", None), 3),
    (TERMINUS, 200, ("at", "Z", None, None, None), (None, None), 5),
    ([], 5, ("unknown", None, None, None, None), (None, None), None),
])
def test_station_state(spark, stus, now, state, following, sequence):
    df = spark.createDataFrame([(stus,)], f"u {STU}")
    row = df.select(st.station_state(F.col("u"), F.lit(now)).alias("s"), st.next_stop(F.col("u"), F.lit(now)).alias("n"),
                    st.progress_sequence(F.col("u"), F.lit(now)).alias("p")).first()
    assert (tuple(row.s), tuple(row.n), row.p) == (state, following, sequence)


def test_last_dwell_option(spark):
    df = spark.createDataFrame([(WINDOW,)], f"u {STU}")
    assert df.select(st.station_state(F.col("u"), F.lit(310), last_dwell_is_at=True).alias("s")).first().s.at_stop_id == "C"


def test_declared_capture_schema_keeps_quoted_numbers(spark):
    raw = spark.createDataFrame([(json.dumps(poll(0, tu("a"))),)], "j string").select(F.from_json("j", CAPTURE).alias("c"))
    assert raw.select("c.feed.header.timestamp").first()[0] == "1000"


def test_alike_alerts_and_requests_are_matched_as_one(spark):
    """Totals per request without a row per (request, alert): the pairs do not grow with alerts of the same entities."""
    entity = "struct<route_id: string, stop_id: string, direction_id: int>"
    schema = f"id string, active_periods array<struct<start_at: timestamp, end_at: timestamp>>, informed_entities array<{entity}>"
    sets = [[], [("R1", None, None)], [("R1", None, None), (None, "S1", None)], [(None, None, 1)], [("R2", "S1", 0)]]
    data = [(str(n), [], sets[n % 5]) for n in range(50)] + [("3", [], [("R2", None, None)])]  # a second row of alert 3
    alerts = spark.createDataFrame(data, schema)
    asks = [(str(n), ("R1", "R2", None)[n % 3], ("S1", "S2")[n % 2], n % 2) for n in range(60)]
    requests = spark.createDataFrame(asks, "request_id string, route_id string, stop_id string, direction_id int")
    value = F.col("id").cast("bigint")
    want = rows(al.match_alerts(alerts, requests, at(18)).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")))
    groups = al.alike(alerts, at(18), value)
    kinds = requests.select(*al.AXES).distinct().withColumn("request_id", al.asked())
    assert kinds.count() == 6 and groups.count() == 6  # five sets, and alert 3 with that of its second row
    pairs, classes = al.match_by_shape(groups, kinds, at(18))
    assert pairs.count() <= 6 * 6
    common = classes.withColumnRenamed("shape", "_rs").join(kinds.withColumn("_rs", al.shape_of()), "_rs").select("request_id", "id")
    found = pairs.unionByName(common).join(groups, "id").groupBy(F.col("request_id").alias("asked")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    assert rows(requests.withColumn("asked", al.asked()).join(found, "asked"), "request_id", "n", "s") == want
