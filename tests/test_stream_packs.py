"""Rows of keyed streams travel in packs, and dwells and headways are taken from a bucket's columns at once."""

import random
import sys

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalbox.streaming import trips as stream
from tests.conftest import rows

STATES = "trip_id string, at_s long, status string, at_stop_id string, route_id string, direction_id int"


class Map(dict):
    getValue, updateValue = dict.get, dict.__setitem__

    def removeKey(self, key):
        del self[key]


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


def play(keyed, keys, bucket_s, batches):
    """One shard: all batches come in, then every timer runs out in its order, the watermark with it."""
    at = lambda ms: type("At", (), {"getExpiryTimeInMs": staticmethod(lambda: ms), "getCurrentWatermarkInMs": staticmethod(lambda: ms)})
    timers = set()
    keyed.keys, keyed.bucket_s = keys, bucket_s
    keyed.parts, keyed.waiting, keyed.value = Map(), Map(), Value()
    keyed.handle = type("Handle", (), {"registerTimer": staticmethod(timers.add)})
    for batch in batches:
        _, _, buckets, packs = stream._packs(pa.Table.from_pandas(batch, preserve_index=False), bucket_s)
        list(keyed.handleInputRows((0,), iter([pd.DataFrame({"bucket": buckets, "data": packs})]), None))
    found, end = [], -1
    while later := [ms for ms in timers if ms > end]:
        end = min(later)
        found += keyed.handleExpiredTimer((0,), at(end), at(end))
    assert keyed.value.held is None and not keyed.waiting and not keyed.parts  # all has ended
    return pd.concat(found) if found else pd.DataFrame(columns=list(keyed.columns))


def plain(value):
    return None if pd.isna(value) else value


def history(seed, trips=7, n=60):
    rng, data = random.Random(seed), []
    for trip in [*(f"t{k}" for k in range(trips)), None]:
        at = rng.randint(0, 50)
        for _ in range(n):
            data.append((trip, at, rng.choice(["at", "at", "at", "between", None]), rng.choice(["A", "A", "B", None]), rng.choice(["R", None]),
                         None if trip == "t5" else 1))
            at += rng.choice([1, 7, 90, 249, 250, 251, 900])
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("seed,bucket_s", [(1, 100), (2, 3600), (3, 1)])
def test_dwells_of_a_bucket_equal_a_plain_walk(seed, bucket_s):
    data, names = history(seed), [c.split()[0] for c in STATES.split(", ")]
    want, last = [], {}
    for trip, at, status, place, route, direction in sorted(data, key=lambda r: r[1]):
        stop, before = place if status == "at" else None, last.get(trip)
        same = before is not None and before[0] == stop and at - before[1] < 250
        if stop and not same and direction is not None and at > 40:
            want.append((trip, stop, route, direction, at))
        last[trip] = (stop, at)
    frame = pd.DataFrame(data, columns=names).astype({"direction_id": "Int32"})
    got = play(stream.Dwell(40, 250), ("trip_id",), bucket_s, [frame[:100], frame[100:350], frame[350:]])
    found = [tuple(map(plain, r)) for r in got[["trip_id", "stop_id", "route_id", "direction_id", "at_s"]].itertuples(index=False)]
    assert sorted(found, key=repr) == sorted(want, key=repr) and len(want) > 50


@pytest.mark.parametrize("seed,bucket_s", [(4, 100), (5, 3600), (6, 10)])
def test_headways_of_a_bucket_equal_a_plain_walk(seed, bucket_s):
    """Several trips at one second, groups without a route, groups that start anew."""
    rng, data = random.Random(seed), []
    for stop, route in (("A", "R"), ("A", None), ("B", "R"), ("C", "R")):
        at = rng.randint(0, 50)
        for n in range(120 if stop != "C" else 1):
            data.append((stop, route, n % 2, f"t{rng.randint(0, 99)}x{n}", at))
            at += rng.choice([0, 0, 5, 60, 299, 300, 301])
    want, times = [], {}
    for stop, route, direction, trip, at in sorted(data, key=lambda r: (r[4], r[3])):
        held = times.get((stop, route, direction), [])
        held = [*([] if held and at - held[-1] >= 300 else held), at][-6:]
        times[stop, route, direction] = held
        want.append((stop, route, direction, trip, at, len(held), (held[-1] - held[0]) / (len(held) - 1) if len(held) > 1 else None))
    rng.shuffle(data)
    frame = pd.DataFrame(data, columns=["stop_id", "route_id", "direction_id", "trip_id", "at_s"])
    got = play(stream.Headway(300), ("stop_id", "route_id", "direction_id"), bucket_s, [frame[:50], frame[50:]])
    found = [tuple(map(plain, r)) for r in got[list(stream.Headway.columns)].itertuples(index=False)]
    assert sorted(found, key=repr) == sorted(want, key=repr) and {r[5] for r in want} == {1, 2, 3, 4, 5, 6}


def test_python_calls_do_not_grow_with_rows():
    """Thirty thousand rows of a shard take far fewer calls than rows, in both operators."""
    n, calls = 30_000, 0
    states = pd.DataFrame({"trip_id": [f"t{k % 900}" for k in range(n)], "at_s": [k * 2 for k in range(n)], "status": "at",
                           "at_stop_id": [f"S{k % 7}" for k in range(n)], "route_id": "R", "direction_id": 1})

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = play(stream.Dwell(0, 250), ("trip_id",), 21_600, [states])
        after = play(stream.Headway(300), ("stop_id", "route_id", "direction_id"), 21_600, [found.drop(columns="ready_at")])
    finally:
        sys.setprofile(None)
    assert len(after) == len(found) > 20_000 and calls < 15_000


def test_a_stream_reaches_its_operator_in_packs(spark):
    """Packs hold every row once, in their bucket, with the latest instant and the mark of the watermark."""
    data = [(f"t{n % 40}", n * 13 % 9000, float("nan") if n % 3 else 1.5, n % 4) for n in range(2000)]
    df = spark.createDataFrame(data, "trip_id string, at_s long, lat double, shard int").repartition(2).withColumn("ev", F.timestamp_seconds("at_s"))
    field = df.select(F.col("ev").alias("ev", metadata={stream.WATERMARK: 1000}))
    marked = df.drop("ev").withColumn("ev", F.timestamp_seconds("at_s").alias("ev", metadata={stream.WATERMARK: 1000}))
    packed = stream._packed(marked, 3600)
    assert packed.schema["ev"].metadata == field.schema["ev"].metadata
    packs = packed.withColumn("ev", F.unix_seconds("ev")).collect()
    assert len(packs) <= 2 * 4 * 3
    found = []
    for p in packs:
        (table,) = stream._opened(stream._joined([bytes(p.data)]))
        held = table.to_pylist()
        assert {r["shard"] for r in held} == {p.shard} and {r["at_s"] // 3600 for r in held} == {p.bucket} and max(r["at_s"] for r in held) == p.ev
        found += [(r["trip_id"], r["at_s"], r["lat"], r["shard"]) for r in held]
    assert sorted(found, key=repr) == sorted(((t, at, None if lat != lat else lat, s) for t, at, lat, s in data), key=repr)
    bare = marked.withColumn("at_s", F.when(F.col("at_s") > 5, F.col("at_s")))
    with pytest.raises(Exception, match="no instant"):
        rows(stream._packed(bare, 3600))
