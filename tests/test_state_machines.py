"""Batch closed forms against a plain tick-by-tick simulation, and streams against batch."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from signalbox.operators import completion as co
from signalbox.operators import headway as hw
from signalbox.operators import lifecycle as lc
from signalbox.operators import observe as ob
from signalbox.operators.feeds import newly_raised
from signalbox.streaming import trips as stream
from tests.conftest import rows

STEP, COAST, EVICT, KEEP = 10, 90, 7200, 21600


def simulate_ghosts(cycles, touches, resolutions):
    """Tick every trip through every cycle."""
    state, stored, out, last = {}, {}, [], None

    def emit(trip, s, at, reason, back=None):
        start = s.get("start")
        out.append((trip, reason, at, s.get("seen"), start, None if start is None else float(at - start), bool(s.get("froze"))))

    for at, backoff in cycles:
        delta = 0 if last is None else at - last
        last = at
        here = touches.get(at, {})
        for trip in sorted(set(state) | set(here)):
            s = state.setdefault(trip, {"status": None, "elapsed": 0})
            if trip in here:
                s["touched"] = at
            if here.get(trip):
                if s["status"] == "ghost":
                    emit(trip, s, at, "reappeared")
                stored.pop(trip, None)
                state[trip] = {"status": "live", "elapsed": 0, "seen": at, "touched": at}
                continue
            if s.get("seen") is None:
                if trip in stored:
                    emit(trip, s, at, stored.pop(trip)[0])
                    del state[trip]
                else:
                    s["status"] = "ghost"
                continue
            if backoff:
                s["froze"] = True
            else:
                s["elapsed"] += delta
            if s["elapsed"] >= COAST:
                if trip in stored:
                    emit(trip, s, at, stored.pop(trip)[0])
                    del state[trip]
                    continue
                if s["status"] != "ghost":
                    s["start"] = at
                s["status"] = "ghost"
            else:
                s["status"] = "coasting"
        for trip in [t for t, s in state.items() if at - s["touched"] >= EVICT]:
            if state[trip]["status"] == "ghost":
                emit(trip, state[trip], at, "timed_out")
            del state[trip]
            stored.pop(trip, None)
        for trip in [t for t, r in stored.items() if at - r[1] >= KEEP]:
            del stored[trip]
        for trip, reason in resolutions.get(at, []):
            if trip in state and state[trip]["status"] == "ghost":
                emit(trip, state[trip], at, reason)
                del state[trip]
            else:
                stored[trip] = (reason, at)
    for trip, s in state.items():
        if s["status"] == "ghost":
            emit(trip, s, last, "flushed")
    return sorted(out, key=repr), state


def capture(seed, with_resolutions, backoff_rate=0.04):
    rng = random.Random(seed)
    cycles, at, backoff = [], 100_000, False
    for _ in range(1800):
        at += STEP
        backoff = rng.random() < (0.9 if backoff else backoff_rate)
        cycles.append((at, backoff))
    touches, resolutions = {}, {}
    for n in range(14):
        trip, present, fixed, i = f"t{n}", True, rng.random() < 0.7, rng.randint(0, 300)
        while i < len(cycles):
            run = rng.choice([1, 2, 8, 9, 12, 40, 200, 760])
            for at, _ in cycles[i:i + run]:
                if present:
                    touches.setdefault(at, {})[trip] = fixed
            i += run
            present, fixed = rng.random() < 0.6, rng.random() < 0.5
        if with_resolutions and n % 2:
            at = rng.choice(cycles)[0]
            resolutions.setdefault(at, []).append((trip, "completed"))
    return cycles, touches, resolutions


def frames(spark, cycles, touches, resolutions):
    flat = [(t, at, pos, 1.0, 2.0) for at, here in touches.items() for t, pos in here.items()]
    return (
        spark.createDataFrame(flat, "trip_id string, at long, has_position boolean, lat double, lon double"),
        spark.createDataFrame(cycles, "at long, backoff boolean"),
        spark.createDataFrame([(t, at, r) for at, rs in resolutions.items() for t, r in rs], "trip_id string, at long, reason string"),
    )


COLUMNS = ["trip_id", "reason", "emitted_at", "last_seen_at", "ghost_started_at", "ghost_duration_s", "backoff_overlapped"]


@pytest.mark.parametrize("seed,resolved", [(1, False), (2, False), (3, True), (4, True), (5, True)])
def test_ghost_episodes_match_simulation(spark, seed, resolved):
    cycles, touches, resolutions = capture(seed, resolved)
    want, state = simulate_ghosts(cycles, touches, resolutions)
    t, c, r = frames(spark, cycles, touches, resolutions)
    got = lc.ghost_episodes(t, c, r if resolved else None)
    assert rows(got, *COLUMNS) == want
    if not resolved:
        tracked = rows(lc.tracked_trips(t, c), "trip_id", "status", "last_seen_at", "ghost_started_at")
        assert tracked == sorted(((k, s["status"], s.get("seen"), s.get("start")) for k, s in state.items()), key=repr)


def play(spark, tmp_path, data, schema, build, name, files=4, order=None, delay_s=10):
    """Feed rows file by file, in ``order``, through a streaming operator and collect its output."""
    data = sorted(data, key=lambda r: r["at_s"])
    src = tmp_path / name
    src.mkdir()
    size = -(-len(data) // files)
    # a late marker row moves the watermark on at the end, so that timers fire
    for i in range(files):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in data[i * size:(i + 1) * size]))
    for turn, i in enumerate(order or range(files)):
        os.utime(src / f"{i}.json", (1_700_000_000 + turn, 1_700_000_000 + turn))
    for i, later in enumerate((100_000, 200_000)):
        marker = {"trip_id": "end", "at_s": data[-1]["at_s"] + later, "kind": 9}
        (src / f"{files + i}.json").write_text(json.dumps(marker))
    stream.use_state_store(spark)
    df = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        .withColumn("ev", F.timestamp_seconds("at_s")).withWatermark("ev", f"{delay_s} seconds")
    )
    query = build(df).writeStream.format("memory").queryName(name) \
        .outputMode("append").option("checkpointLocation", str(tmp_path / (name + "-ck"))).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name).filter("trip_id != 'end'")


LIFE = "kind int, at_s long, backoff boolean, trip_id string, has_position boolean, lat double, lon double, reason string"


@pytest.mark.parametrize("seed,resolved,backoff_rate", [(11, False, 0.0), (12, False, 0.04), (13, True, 0.04), (14, True, 0.2)])
def test_lifecycle_stream_equals_simulation(spark, tmp_path, seed, resolved, backoff_rate):
    """Backoffs freeze the clock of trips that bring no rows themselves; outcomes come after the positions of their cycle."""
    cycles, touches, resolutions = capture(seed, resolved, backoff_rate)
    if resolved:  # some trips with several outcomes, and outcomes in cycles in which the trip is seen
        rng = random.Random(seed)
        for n in range(14):
            for at, _ in rng.sample(cycles, 3):
                resolutions.setdefault(at, []).append((f"t{n}", rng.choice(["completed", "cancelled"])))
        resolutions = {at: list({t: (t, r) for t, r in found}.values()) for at, found in resolutions.items()}
    none = dict.fromkeys(("backoff", "trip_id", "has_position", "lat", "lon", "reason"))
    data = [none | dict(kind=stream.CYCLE, at_s=at, backoff=b) for at, b in cycles]
    data += [none | dict(kind=stream.TOUCH, at_s=at, trip_id=t, has_position=pos, lat=1.0, lon=2.0) for at, here in touches.items() for t, pos in here.items()]
    data += [none | dict(kind=stream.OUTCOME, at_s=at, trip_id=t, reason=r) for at, rs in resolutions.items() for t, r in rs]
    got = play(spark, tmp_path, data, LIFE, lambda df: stream.ghost_episodes(df, shards=3), f"ghosts{seed}", order=(1, 0, 3, 2), delay_s=20_000)
    found = rows(got, "trip_id", "reason", "emitted_s", "last_seen_s", "ghost_started_s", "ghost_duration_s", "backoff_overlapped")
    want, _ = simulate_ghosts(cycles, touches, resolutions)
    assert found == [w for w in want if w[1] != "flushed"]
    seen = {f[1] for f in found}
    assert "reappeared" in seen and ({"completed", "cancelled"} & seen if resolved else "timed_out" in seen)


def simulate_completions(cycles, seen):
    pending, final, out = {}, {}, []
    for at in cycles:
        for trip, row in sorted(seen.get(at, {}).items()):
            if trip not in pending:
                if trip in final or not row["has_terminus"]:
                    continue
                pending[trip] = {"route": row["route_id"]}
            pending[trip]["touched"] = at
            pending[trip]["route"] = row["route_id"] or pending[trip]["route"]
            if row["outcome"]:
                out.append((trip, at, row["outcome"], pending.pop(trip)["route"]))
                final[trip] = at
        for trip in [t for t, p in pending.items() if at - p["touched"] >= EVICT]:
            out.append((trip, at, "undetermined_gap", pending.pop(trip)["route"]))
            final[trip] = at
        for trip in [t for t, f in final.items() if at - f >= KEEP]:
            del final[trip]
    out += [(t, cycles[-1], "undetermined_gap", p["route"]) for t, p in pending.items()]
    return sorted(out, key=repr)


def completion_capture(seed):
    rng = random.Random(seed)
    cycles = [50_000 + 60 * i for i in range(2400)]
    seen = {}
    for n in range(10):
        i = rng.randint(0, 200)
        while i < len(cycles):
            length, end = rng.randint(1, 60), rng.choice(["on_time", "late", "cancelled", None, None])
            for j, at in enumerate(cycles[i:i + length]):
                outcome = end if j >= length - 3 else None
                seen.setdefault(at, {})[f"t{n}"] = dict(
                    has_terminus=n != 3, route_id=rng.choice([None, "R1", "R2"]), outcome=outcome if n != 3 else None)
            i += length + rng.choice([5, 130, 700, 900])
    return cycles, seen


def completion_frames(spark, cycles, seen):
    """Rows whose stop updates give exactly the wanted outcome."""
    flat = []
    for at, here in seen.items():
        for trip, r in here.items():
            delay = {"on_time": 299, "late": 300}.get(r["outcome"])
            stus = [("X", "5", "6", 1, 1)] + ([("T", str(at), None, delay, None)] if delay is not None else [("T", str(at), str(at), 0, 0)])
            flat.append((trip, at, "20240101", r["route_id"], "CANCELED" if r["outcome"] == "cancelled" else "SCHEDULED", stus))
    schema = ("trip_id string, at long, start_date string, route_id string, relationship string, stop_time_updates "
              "array<struct<stop_id: string, arr_time: string, dep_time: string, arr_delay: int, dep_delay: int>>")
    termini = spark.createDataFrame([(f"t{n}", "T") for n in range(10) if n != 3], "trip_id string, terminus_stop_id string")
    termini = termini.withColumns({"service_date": F.to_date(F.lit("2024-01-01")), "scheduled_arrival": F.timestamp_seconds(F.lit(0))})
    return spark.createDataFrame(flat, schema), termini, spark.createDataFrame([(c,) for c in cycles], "at long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_completions_match_simulation(spark, seed):
    cycles, seen = completion_capture(seed)
    got = co.trip_completions(*completion_frames(spark, cycles, seen))
    assert rows(got, "trip_id", "finalized_at", "status", "route_id") == simulate_completions(cycles, seen)


def test_completion_stream_equals_batch(spark, tmp_path):
    cycles, seen = completion_capture(7)
    data = [
        dict(trip_id=t, at_s=at, has_terminus=r["has_terminus"], service_date="d", route_id=r["route_id"], outcome=r["outcome"],
             actual_s=None, delay_seconds=None) for at, here in seen.items() for t, r in here.items()]
    schema = ("trip_id string, at_s long, has_terminus boolean, service_date string, route_id string, outcome string,"
              "actual_s long, delay_seconds long")
    got = play(spark, tmp_path, data, schema, stream.completions, "outcomes")
    decided = lambda found: sorted(((t, a, s, r) for t, a, s, r in found if s != "undetermined_gap"), key=repr)
    want = simulate_completions(cycles, seen)
    found = rows(got, "trip_id", "finalized_s", "status", "route_id")
    assert decided(found) == decided(want)
    # undetermined outcomes carry the timer's instant instead of the next cycle
    assert sorted((t, s) for t, _, s, _ in found) == sorted((t, s) for t, _, s, _ in want)


def greedy(times, interval):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= interval:
            kept.append(t)
    return kept


@pytest.mark.parametrize("chunk_s", [50, 130, 3600])
def test_pacing_matches_greedy(spark, chunk_s):
    rng = random.Random(3)
    times = {f"t{n}": rng.sample(range(8000), rng.choice([1, 5, 300])) for n in range(8)}
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "trip_id string, at long")
    want = sorted(((k, t) for k, ts in times.items() for t in greedy(ts, 120)), key=repr)
    assert rows(ob.paced(df, interval_s=120, chunk_s=chunk_s)) == want


def test_pacing_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    times = {f"t{n}": rng.sample(range(9000), 200) for n in range(3)}
    data = [dict(trip_id=k, at_s=t) for k, ts in times.items() for t in ts]
    got = play(spark, tmp_path, data, "trip_id string, at_s long", stream.paced, "paced")
    assert rows(got) == sorted(((k, t) for k, ts in times.items() for t in greedy(ts, 120)), key=repr)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 3, 2), (3, 1, 2, 0)])
def test_headway_stream_equals_batch(spark, tmp_path, order):
    rng = random.Random(4)
    data = []
    for n in range(6):
        at = 100 + n
        for _ in range(40):
            data.append(dict(trip_id=f"t{n}", at_s=at, status=rng.choice(["at", "at", "between"]), at_stop_id=rng.choice(["A", "B"]),
                             route_id="R", direction_id=None if n == 5 else n % 2))
            at += 10 * rng.randint(1, 9)
    schema = "trip_id string, at_s long, status string, at_stop_id string, route_id string, direction_id int"
    first = min(r["at_s"] for r in data)
    batch = spark.createDataFrame(data, schema).withColumnRenamed("at_s", "at")
    got = play(spark, tmp_path, data, schema, lambda df: stream.arrivals(df, first), f"arrivals_{order[0]}", order=order, delay_s=20_000)
    want = hw.arrivals(batch)
    assert rows(got, "trip_id", "stop_id", "at_s") == rows(want, "trip_id", "stop_id", "arrived_at")


def test_arrivals_across_chunks(spark):
    """Chunks of any width give the arrivals of a plain walk; only first and last rows of chunks meet, without a join of all."""
    rng, data = random.Random(6), []
    for n in range(8):
        at = n
        for _ in range(60):
            data.append((f"t{n}", at, rng.choice(["at", "at", "between"]), rng.choice(["A", "B"]), "R", None if n == 5 else n % 2))
            at += rng.choice([1, 30, 700, 30_000])
    want, first = [], min(r[1] for r in data)
    for n in range(8):
        before = None
        for trip, at, status, place, route, direction in (r for r in data if r[0] == f"t{n}"):
            stop = place if status == "at" else None
            resumed = before is not None and before[0] == stop and at - before[1] < hw.DWELL_RETENTION_S
            if stop and not resumed and direction is not None and at > first:
                want.append((trip, stop, at))
            before = (stop, at)
    states = spark.createDataFrame(data, "trip_id string, at long, status string, at_stop_id string, route_id string, direction_id int")
    for chunk_s in (20, 3600, 10_000_000):
        assert rows(hw.arrivals(states, chunk_s=chunk_s), "trip_id", "stop_id", "arrived_at") == sorted(want, key=repr)
    plan = hw.arrivals(states)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 3, 1)])
def test_two_operator_headway_stream_equals_batch(spark, tmp_path, order):
    """Dwells per trip and the last arrivals per group as one stream, files in any order."""
    rng = random.Random(8)
    data = []
    for n in range(12):
        at = 100 + n
        for _ in range(80):
            data.append(dict(trip_id=f"t{n}", at_s=at, status=rng.choice(["at", "at", "between"]), at_stop_id=rng.choice(["A", "B"]),
                             route_id="R", direction_id=None if n == 5 else n % 2))
            at += rng.choice([10, 30, 900])
    schema = "trip_id string, at_s long, status string, at_stop_id string, route_id string, direction_id int"
    first = min(r["at_s"] for r in data)
    chain = lambda df: stream.rolling_headways(stream.arrivals(df, first))
    got = play(spark, tmp_path, data, schema, chain, f"headways_{order[0]}", order=order, delay_s=60_000)
    want = hw.rolling_headways(hw.arrivals(spark.createDataFrame(data, schema).withColumnRenamed("at_s", "at")), chunk_s=600)
    names = ["stop_id", "direction_id", "trip_id"]
    assert rows(got, *names, "at_s", "sample_size", "average_headway_seconds") == rows(want, *names, "arrived_at", "sample_size", "average_headway_seconds")
    assert got.count() > 200


def test_waiting_rows_lie_in_buckets():
    """A timer reads the rows of its own bucket only, and a part is written without reading the others."""
    class Map(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    keyed = stream.Pacing(120)
    keyed.parts, keyed.waiting, timers = Map(), Map(), []
    keyed.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    import pandas as pd
    for batch in ([10, 3700], [3599, 20], [7300]):
        list(keyed.handleInputRows(("t",), iter([pd.DataFrame({"trip_id": "t", "at_s": batch})]), None))
    assert timers == [3_600_000, 7_200_000, 10_800_000] and len(keyed.waiting) == 4
    assert [r["at_s"] for r in keyed._take(0)] == [10, 20, 3599] and len(keyed.waiting) == 2 and keyed._take(0) == []


def test_a_shard_calls_its_state_per_bucket_for_all_its_keys():
    """Five hundred trips of a shard: a part per bucket, one read and one write of state per timer, the pace of each trip of its own."""
    import pandas as pd

    class Map(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

        def clear(self):
            self.calls, self.held = self.calls + 1, None

    at = lambda s: type("At", (), {"getExpiryTimeInMs": staticmethod(lambda: s), "getCurrentWatermarkInMs": staticmethod(lambda: s)})
    keyed = stream.Pacing(5000)
    keyed.keys, timers = ("trip_id",), []
    keyed.parts, keyed.waiting, keyed.value = Map(), Map(), Value()
    keyed.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    data = pd.DataFrame([(f"t{n}", s + n % 7) for n in range(500) for s in (100, 3700, 5200, 8000)], columns=["trip_id", "at_s"])
    list(keyed.handleInputRows((3,), iter([data]), None))
    assert timers == [3_600_000, 7_200_000, 10_800_000] and len(keyed.waiting) == 3
    found = pd.concat([f for end in timers[:3] for f in keyed.handleExpiredTimer((3,), at(end), at(end))])
    assert sorted(zip(found.trip_id, found.at_s)) == sorted((f"t{n}", s + n % 7) for n in range(500) for s in (100, 5200))
    assert keyed.value.calls <= 6 and not keyed.waiting and not keyed.parts
    for end in timers[3:]:
        list(keyed.handleExpiredTimer((3,), at(end), at(end)))
    assert keyed.value.held is None  # every pace has ended


def test_edge_trigger(spark):
    df = spark.createDataFrame([("a", "x", c) for c in (1, 2, 3, 5, 9, 10)], "trip_id string, discrepancy_type string, cycle long")
    assert [r[2] for r in rows(newly_raised(df, "cycle"))] == [1, 5, 9]


def test_headway_info_boundaries(spark):
    arrived = spark.createDataFrame(
        [("A", "R", 0, f"t{i}", t) for i, t in enumerate((0, 100, 200))] + [("B", "R", 0, "t9", 50), ("C", "R", 1, "x", 0), ("C", "R", 1, "y", 60)],
        "stop_id string, route_id string, direction_id int, trip_id string, arrived_at long")
    at = lambda now: {r.stop_id: r for r in hw.headways_at(arrived, F.lit(now)).collect()}
    now = at(400)
    assert now["A"].average_headway_seconds == 100 and not now["A"].gap_detected  # exactly twice is no gap
    assert at(401)["A"].gap_detected
    assert now["B"].average_headway_seconds is None and now["B"].seconds_since_last_arrival == 350
    assert now["C"].sample_size == 2 and not at(10_000)["C"].gap_detected
