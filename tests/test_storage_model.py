import io
import random
import zipfile
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from signalbox.operators import archive as ar
from signalbox.operators import model as md
from signalbox.operators import rollups as ro
from signalbox.schemas import EVENT_TABLES
from signalbox.sources import static as ss
from signalbox.sources import store
from signalbox.streaming import jobs
from tests.conftest import rows

UTC = timezone.utc
DAY = date(2026, 7, 1)


# --- timetable files ---

FILES = {
    "stops.txt": '"stop_id","stop_name","stop_lat","stop_lon","location_type","parent_station"\n'
                 'S,"Old, name",-37,144,0,P\nS,New,-37.5,144.5,,P\nP,Main,-37,144,1,Z\n',
    "trips.txt": "route_id,service_id,trip_id,trip_headsign,direction_id\nR,W,t1,,1\nR,W,t2,City,\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,0,1,0,0,0, 1 ,20260101,20261231\n",
}


def archive(files, bom=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text if isinstance(text, bytes) else (("﻿" if bom else "") + text).encode())
    return out.getvalue()


def test_archive_ingest(spark, tmp_path):
    inner = archive(FILES)
    (tmp_path / "gtfs.zip").write_bytes(archive({"1/google_transit.zip": archive({"trips.txt": "trip_id\nother\n"}), "2/google_transit.zip": inner}))
    lines = ss.read_archives(spark, str(tmp_path / "*.zip"))
    assert rows(lines, "mode", "member") == [("2", "calendar.txt"), ("2", "stops.txt"), ("2", "stops.txt"), ("2", "stops.txt"),
                                             ("2", "trips.txt"), ("2", "trips.txt")]
    import hashlib
    assert {r[0] for r in rows(lines, "digest")} == {hashlib.sha256(inner).hexdigest()}
    stops = ss.parse_stops(ss.member_rows(lines, "stops.txt", ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"]))
    assert rows(stops, "stop_id", "name", "parent_station", "location_type") == [("P", "Main", None, 1), ("S", "New", "P", 0)]
    trips = ss.parse_trips(ss.member_rows(lines, "trips.txt", ["route_id", "service_id", "trip_id", "trip_headsign", "direction_id"]))
    assert rows(trips, "trip_id", "headsign", "direction_id") == [("t1", "", 1), ("t2", "City", None)]
    assert ss.new_snapshots(lines, lines.select("digest")).count() == 0


def test_archive_blocks(spark):
    """Records with quoted line ends and of any length come through blocks of any size; other modes do not."""
    rng = random.Random(2)
    names = [rng.choice(["plain", 'a "quoted", name', "two\nlines", "x" * 300, "", " padded "]) for _ in range(400)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    text = '\ufeffstop_id,stop_name,,stop_id\r\n' + "".join(f"{i},{quoted(n)},z,y\r\n\r\n" for i, n in enumerate(names)) + "400,short"
    content = archive({"2/google_transit.zip": archive({"stops.txt": text.encode()}), "1/google_transit.zip": archive({"stops.txt": b"no"})})
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    for size in (7, 100, 1 << 20):
        lines = ss.unpacked(df, block_bytes=size)
        got = lines.orderBy("pos").select(F.col("fields.stop_id").cast("int").alias("i"), F.coalesce("fields.stop_name", F.lit("")).alias("n")).collect()
        assert [(r.i, r.n) for r in got] == [*enumerate(names), (400, "short")]
    with pytest.raises(Exception, match="asked for"):
        ss.unpacked(df, modes=("2", "7")).count()


def test_plain_and_quoted_records(spark):
    """Records with and without quotes give the same values; a filter on a field parses no record a second time."""
    text = 'stop_id,stop_name,code\n1,plain,x\n2,"quoted, name",\n3,, \n"4","",y\n5,short\n6,long,z,more\n7,"say ""hi""",\n'
    content = archive({"2/google_transit.zip": archive({"stops.txt": text, "routes.txt": "route_id\nR\n"})})
    lines = ss.unpacked(spark.createDataFrame([(bytearray(content),)], "content binary"))
    stops = ss.member_rows(lines, "stops.txt", ["stop_id", "stop_name", "code"])
    assert rows(stops, "stop_id", "stop_name", "code") == [
        ("1", "plain", "x"), ("2", "quoted, name", None), ("3", None, " "), ("4", None, "y"), ("5", "short", None),
        ("6", "long", "z"), ("7", 'say "hi"', None)]
    assert rows(ss.member_rows(lines, "routes.txt", ["route_id"]), "route_id") == [("R",)]
    plan = stops.filter("stop_id is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("from_csv(") for line in plan.splitlines() if "Filter" in line) == 0 and plan.count("from_csv(") == 1


def test_last_row_follows_file_names(spark, tmp_path):
    """A large file is read in several splits and before a small one, yet the row of the last file by name wins."""
    big = "route_id,route_short_name,route_long_name\n" + "".join(f"R{i % 50},a{i},long name {i}\n" for i in range(40_000))
    (tmp_path / "a.txt").write_text(big)
    (tmp_path / "b.txt").write_text("route_id,route_short_name,route_long_name\nR1,old,x\nR1,new,x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = {r.route_id: r.short_name for r in ss.parse_routes(ss.read_csv(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"R{i}": f"a{39_950 + i}" for i in range(50)} | {"R1": "new"}


def test_plain_files(spark, tmp_path):
    path = tmp_path / "calendar.txt"
    path.write_text("﻿" + FILES["calendar.txt"])
    got = ss.parse_calendar(ss.read_csv(spark, str(path))).first()
    assert (got.service_id, got.monday, got.tuesday, got.sunday, got.start_date) == ("W", True, False, True, date(2026, 1, 1))
    assert ss.read_optional_csv(spark, str(tmp_path / "none.txt"), ["service_id", "date", "exception_type"]).count() == 0


# --- rollups ---


def events(spark, *data):
    return spark.createDataFrame(list(data), "service_date date, trip_id string, route_id string, n int, status string, delay_seconds int, actual_at timestamp")


@pytest.fixture(scope="module")
def routes(spark):
    return spark.createDataFrame([("A:", "Alpha", "A"), ("A-R:", "Replacement Bus", "A"), ("B:", "Beta", "B"), ("B-R:", "Replacement Bus", "B")],
                                 "route_id string, short_name string, long_name string")


def test_day_rollups(spark, routes):
    at = datetime(2026, 7, 1, 0, 30, tzinfo=UTC)  # 10:30 local
    raw = events(
        spark, (DAY, "t1", "A:", 1, "on_time", 5, at), (DAY, "t1", "A:", 2, "late", 900, at), (DAY, "t2", "A:", 1, "late", None, at),
        (DAY, "t3", "A-R:", 1, "cancelled", None, None), (DAY, "t4", "B-R:", 1, "on_time", 0, at), (DAY, "t5", "new", 1, "late", 600, at),
        (DAY, "t6", None, 1, "on_time", 0, at), (DAY, "t6", "A:", 2, "on_time", 0, at), (DAY, "t7", "A:", 1, "undetermined_gap", None, None))
    first = ro.first_completions(raw, ["n"])
    assert rows(ro.line_day_rollup(first, routes), "route_id", *ro.LINE_COUNTS) == [("A:", 1, 1, 0, 1, 1), ("new", 0, 1, 0, 0, 0)]
    assert rows(ro.hour_day_rollup(first, routes), "route_id", "hour_local", "completion_count") == [("A:", 10, 2), ("new", 10, 1), (None, 10, 3)]
    assert rows(ro.histogram_day_rollup(first, routes), *ro.HISTOGRAM_COUNTS) == [(1, 1, 1, 0, 1)]
    empty = ro.histogram_day_rollup(first.filter("trip_id = 't6'"), routes)
    assert rows(empty, *ro.HISTOGRAM_COUNTS) == [(0, 0, 0, 0, 0)]


def test_weekly_counts_every_event(spark):
    rng = random.Random(2)
    data = [(DAY, "same", "A:", i, rng.choice(["on_time", "late", "undetermined_gap"]), 0, None) for i in range(40)]
    data += [(DAY, f"b{i}", "B:", i, "late", 0, None) for i in range(19)] + [(DAY, "c", None, 1, "cancelled", None, None)]
    df = events(spark, *data)
    ran = sum(s in ("on_time", "late") for _, t, r, _, s, *_ in data if r == "A:")
    assert rows(ro.weekly_line_stats(df), "route_id", "trip_count") == ([("A:", ran)] if ran >= 20 else [])
    network = ro.weekly_network_stats(df).first()
    assert (network.late_count + network.on_time_count, network.cancelled_count, network.days_covered) == (ran + 19, 1, 1)


def test_series_keep_missing_days(spark, routes):
    days = [DAY + timedelta(days=i) for i in range(3)]
    lines = ro.line_day_rollup(events(spark, (DAY, "t", "A:", 1, "on_time", 0, None)), routes)
    assert rows(ro.daily_series(lines, days), "on_time_count", "has_data") == [(0, False), (0, False), (1, True)]
    assert rows(ro.in_days(lines, [DAY, days[2]]), "route_id") == [("A:",)] and ro.in_days(lines, []).count() == 0
    assert ro.hour_series(ro.sum_hours(ro.hour_day_rollup(events(spark), routes), days)).count() == 24


# --- store ---


def test_days_registry_and_coverage(spark, tmp_path):
    base, table = str(tmp_path), "trip_completion_events"
    at = datetime(2026, 7, 1, 16, 30, tzinfo=UTC)  # 02:30 local on the 2nd, still the 1st's service day
    rows_in = spark.createDataFrame([("t", "A:", None, at, 5, "on_time")], "trip_id string, route_id string, scheduled_terminus_arrival timestamp, actual_terminus_arrival timestamp, delay_seconds int, status string")
    store.append_events(rows_in, base, table, "actual_terminus_arrival")
    known = spark.createDataFrame([(DAY, table, "d"), (DAY + timedelta(days=1), table, "d"), (DAY + timedelta(days=2), "ghost_events", "d")], "service_date date, table string, digest string")
    store.register_days(spark, base, known)
    store.register_days(spark, base, known)
    assert store.read_registry(spark, base).count() == 3
    got, coverage = store.read_days(spark, base, table, [DAY + timedelta(days=i) for i in range(3)])
    assert rows(got, "service_date", "trip_id") == [(DAY, "t")]
    assert [r[1] for r in rows(coverage)] == [True, True, False]  # an empty day is covered, a missing table is not


def test_closed_and_retention(spark):
    closed = lambda now: spark.range(1).select(store.is_closed(F.lit(DAY), F.lit(now)).alias("c")).first().c
    edge = datetime(2026, 7, 1, 17, 30, tzinfo=UTC)
    assert closed(edge) and not closed(edge - timedelta(seconds=1))
    days = spark.createDataFrame([(DAY - timedelta(days=d),) for d in (60, 61, 90)], "service_date date")
    backed = days.filter(F.col("service_date") == F.lit(DAY - timedelta(days=61)))
    plan = store.retention_plan(days, F.lit(DAY), must_be_in=backed)
    assert [r[1] for r in sorted(rows(plan), reverse=True)] == ["keep", "delete", "skipped_not_backed_up"]


def test_upsert_replaces_only_its_days(spark, tmp_path):
    path, make = str(tmp_path / "r"), lambda *r: spark.createDataFrame(list(r), "service_date date, route_id string, n int")
    store.upsert_days(make((DAY, "A", 1), (DAY, "B", 1), (DAY + timedelta(days=1), "A", 5)), path)
    store.upsert_days(make((DAY, "A", 2)), path)
    assert rows(spark.read.parquet(path), "service_date", "route_id", "n") == [(DAY, "A", 2), (DAY + timedelta(days=1), "A", 5)]


def test_archive_pass(spark, tmp_path):
    base, backup, out, report = (str(tmp_path / n) for n in ("a", "b", "arch", "report"))
    days = [DAY + timedelta(days=i) for i in range(3)]
    gap = spark.createDataFrame([(days[0], datetime(2026, 7, 1, tzinfo=UTC), datetime(2026, 7, 1, 1, tzinfo=UTC), "weird", 2, 60.0)],
                                "service_date date, started_at timestamp, ended_at timestamp, reason string, consecutive_failures int, max_level_reached_s double")
    ghost = spark.createDataFrame([(days[0], "t", 1.5), (days[1], "u", 2.5)], "service_date date, trip_id string, ghost_duration_s double")
    for root, day in ((base, days[0]), (backup, days[1])):
        store._write(ghost.filter(F.col("service_date") == F.lit(day)), store.table_path(root, "ghost_events"), ["service_date"], "append")
        store.register_days(spark, root, spark.createDataFrame([(day, "ghost_events", "d")], "service_date date, table string, digest string"))
    store._write(gap, store.table_path(base, "poll_gap_events"), ["service_date"], "append")
    spark.createDataFrame([(d,) for d in days], "service_date date").write.parquet(store.table_path(base, "_expected_days"))
    now = datetime(2026, 9, 1, tzinfo=UTC)
    result = ar.run_archive_pass(spark, base, backup, out, report, now)
    assert {k: [r[0] for r in rows(v)] for k, v in result.items() if k in ("archived", "failed", "recovered")} == {
        "archived": days[:2], "failed": [days[2]], "recovered": [days[1]]}
    assert rows(result["drift"], "table", "value") == [("poll_gap_events", "weird")]
    got = ar.read_archive(spark, out, "ghost_events")
    assert rows(got, "service_date", "is_gap_marker", "trip_id", "gap_reason", "schema_version", "reason") == [
        (days[0], False, "t", None, 2, None), (days[0], True, None, "weird", 2, None), (days[1], False, "u", None, 2, None)]
    assert rows(ar.without_markers(got), "trip_id") == [("t",), ("u",)]
    assert rows(ar.fully_archived(ar.archived_days(spark, out))) == [(d,) for d in days[:2]]
    assert rows(store.read_gap_report(spark, report), "service_date", "recovered", "permanent") == [(days[1], True, False), (days[2], False, True)]
    again = ar.run_archive_pass(spark, base, backup, out, report, now)
    assert again["archived"].count() == 0 and again["failed"].count() == 1
    assert store.prune_gap_report(spark, report, now + timedelta(days=200)) == 3


def test_archive_pass_with_a_damaged_day(spark, tmp_path):
    """A truncated file takes its own day from the backup; a day damaged on both sides fails alone."""
    base, backup, out, report = (str(tmp_path / n) for n in ("a", "b", "arch", "report"))
    days = [DAY + timedelta(days=i) for i in range(4)]
    ghost = spark.createDataFrame([(d, f"t{i}", float(i)) for d in days for i in range(200)], "service_date date, trip_id string, ghost_duration_s double")
    for root in (base, backup):
        store._write(ghost, store.table_path(root, "ghost_events"), ["service_date"], "append")
        store.register_days(spark, root, spark.createDataFrame([(d, "ghost_events", "d") for d in days], "service_date date, table string, digest string"))

    def damage(root, day, keep):
        for path in (tmp_path / root / "ghost_events" / f"service_date={day}").glob("*.parquet"):
            data = path.read_bytes()
            path.write_bytes(keep(data))
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)

    damage("a", days[1], lambda b: b[: len(b) // 2])  # no footer
    damage("a", days[2], lambda b: b[:8] + b"\xff" * 400 + b[408:])  # a footer, but pages that do not decode
    damage("b", days[2], lambda b: b"")
    assert sorted(r[0] for r in rows(store.unreadable_days(spark, base, days))) == days[1:3]
    result = ar.run_archive_pass(spark, base, backup, out, report, datetime(2026, 9, 1, tzinfo=UTC))
    assert {k: [r[0] for r in rows(result[k])] for k in ("archived", "failed", "recovered")} == {
        "archived": [days[0], days[1], days[3]], "failed": [days[2]], "recovered": [days[1]]}
    assert ar.read_archive(spark, out, "ghost_events").groupBy("service_date").count().filter("count = 200").count() == 3


def test_finalize_waits_for_the_day(spark, tmp_path, routes):
    base, out, now = str(tmp_path / "h"), str(tmp_path / "o"), datetime(2026, 7, 2, 2, tzinfo=UTC)
    assert not jobs.finalize_yesterday(spark, base, out, routes, now)
    store.register_days(spark, base, spark.createDataFrame([(DAY, "trip_completion_events", "d")], "service_date date, table string, digest string"))
    assert jobs.finalize_yesterday(spark, base, out, routes, now)
    assert not jobs.finalize_yesterday(spark, base, out, routes, now)
    assert jobs.weekly_digest(spark, base, out, now) and not jobs.weekly_digest(spark, base, out, now)


def test_event_schemas_parse(spark):
    assert ar.archive_schema("ghost_events").names[-6:] == [
        "schema_version", "service_date", "is_gap_marker", "gap_started_at", "gap_ended_at", "gap_reason"]
    assert len(EVENT_TABLES) == 5


# --- model ---


def examples(spark, n, noise=0, outlier=None, days=10):
    rng = random.Random(8)
    data = []
    for i in range(n):
        delay, stops, flag = rng.randint(-60, 900), rng.randint(0, 25), rng.random() < 0.4
        y = 12 + 2 * delay - 3 * stops + (40 if flag else 0) + rng.randint(-noise, noise)
        data.append((DAY + timedelta(days=i % days), delay, stops, flag, outlier if outlier and i % 10 == 0 else y))
    return spark.createDataFrame(data, "service_date date, current_delay_s int, stops_remaining int, active_alert_flag boolean, final_delay_s int")


def test_fit_recovers_a_line(spark):
    model = md.fit_linear(md.compact(examples(spark, 200)))
    assert (model.intercept, *model.weights) == pytest.approx((12, 2, -3, 40), abs=1e-3)


def test_least_absolute_resists_outliers(spark):
    df = examples(spark, 300, outlier=50_000)
    clean = examples(spark, 300)
    error = lambda m: md.evaluate(m, clean).first().model_mae
    assert error(md.fit_least_absolute(df)) < 5 < error(md.fit_linear(md.compact(df)))


def test_gate(spark, tmp_path):
    path = str(tmp_path / "model")
    good = md.train_and_gate(examples(spark, 200, noise=5), 2, path)
    assert good.passed and md.load_model(spark, path).weights == pytest.approx(good.model.weights)
    assert not md.train_and_gate(examples(spark, 50, days=1), 2, None).passed  # nothing left to train on
    bad = str(tmp_path / "bad")
    holds = examples(spark, 100).withColumn("final_delay_s", F.col("current_delay_s"))
    assert not md.train_and_gate(holds, 2, bad).passed and not (tmp_path / "bad").exists()


def test_labels_take_the_last_completion(spark):
    obs = spark.createDataFrame([("t", DAY, 1), ("u", DAY, 2)], "trip_id string, service_date date, current_delay_s int")
    done = spark.createDataFrame([("t", DAY, 1, "late", 400), ("t", DAY, 2, "on_time", 10), ("t", DAY, 3, "cancelled", None), ("u", DAY, 1, "cancelled", None)],
                                 "trip_id string, service_date date, n int, status string, delay_seconds int")
    assert rows(md.label_observations(obs, done, ["n"]), "trip_id", "final_delay_s") == [("t", 10)]
