"""Keyed streaming state: lifecycle, completion, pacing, dwell, headway and edge triggers.

Keys are dealt to shards, and a shard's rows wait in state by buckets of event time. Each bucket has a timer of its own, and when the watermark has
passed its end, its rows are taken out and applied in event-time order, whatever order files and micro-batches brought them in;
what arrives within the declared delay is never out of place. Rows travel and wait in packs, columns of many rows as one value, since Spark
hands a stateful Python operator its input row by row. The work of a call is bounded by the rows of one bucket and
the live keys of one shard. Each processor otherwise keeps a few numbers per key. They need the RocksDB state store (``use_state_store``) and an upstream
watermark; what a key keeps ends at a bucket's end too, so nothing grows with the length of the stream.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from signalbox.operators.completion import FINALIZED_RETENTION_S, UNDETERMINED_TIMEOUT_S
from signalbox.operators.headway import DWELL_RETENTION_S, MAX_ARRIVALS
from signalbox.operators.lifecycle import COASTING_TIMEOUT_S, MAX_GHOST_AGE_S, RESOLUTION_RETENTION_S
from signalbox.operators.observe import OBSERVATION_INTERVAL_S

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_S = 3600
SHARDS = 64
WATERMARK = "spark.watermarkDelayMs"  # Spark's mark on the column of event time
HELD_ROWS, PACK_ROWS = 300_000, 20_000  # rows sorted into packs at a time, at most so many in one pack


def use_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


# --- packs ---


def _plain(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """Numbers, truth values and text; NaN is missing, other kinds become text."""
    kind = column.type
    if pa.types.is_floating(kind):
        return pc.if_else(pc.is_nan(column), None, column)
    known = (pa.types.is_integer, pa.types.is_boolean, pa.types.is_string, pa.types.is_large_string, pa.types.is_null)
    return column if any(of(kind) for of in known) else column.cast(pa.string())


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()  # shuffle and state store compress; threads and codecs cost more than a pack
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(use_threads=False)) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _joined(packs: list[bytes]) -> bytes:
    return b"".join(struct.pack("<q", len(p)) + p for p in packs)


def _opened(data: bytes) -> Iterator[pa.Table]:
    """The packs that ``_joined`` put into one value."""
    whole, at = pa.py_buffer(data), 0
    while at < whole.size:
        (size,) = struct.unpack("<q", whole.slice(at, 8))
        yield pa.ipc.open_stream(whole.slice(at + 8, size), options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()
        at += 8 + size


def _packs(rows: pa.Table, bucket_s: int, instant: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Rows sorted by shard and bucket and cut into packs: places of the rows, begins of the packs, their buckets, their values.

    Rows without an ``instant`` get packs of their own. Instants are not used by the processors and stay behind.
    """
    if rows["at_s"].null_count:
        raise TypeError("a row of a keyed stream has no instant (at_s)")
    bucket = (rows["at_s"].to_numpy() // bucket_s).astype("int64")
    by = [rows[instant].is_null().to_numpy()] if instant else []
    by += [bucket, *([rows["shard"].to_numpy()] if "shard" in rows.column_names else [])]
    order = np.lexsort(by)
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for key in by:
        changed[1:] |= np.diff(key[order].astype("int64")) != 0
    starts = np.flatnonzero(changed)
    place = np.arange(len(order))
    starts = np.flatnonzero((place - starts[np.cumsum(changed) - 1]) % PACK_ROWS == 0) if len(order) else starts
    named = [c for c in rows.column_names if not pa.types.is_timestamp(rows[c].type)]
    kept = pa.table({c: _plain(rows[c]) for c in named}).take(order).combine_chunks().to_batches()
    ends = [*starts[1:].tolist(), len(order)]
    return order, starts, bucket[order][starts], [_bytes(kept[0].slice(a, b - a)) for a, b in zip(starts.tolist(), ends)]


def _packed(df: DataFrame, bucket_s: int) -> DataFrame:
    """The stream as packs: a stateful Python operator costs far more for a row than all that is done with it.

    A pack lies in one bucket and has the latest instant of its rows as event time. Rows that are later than the delay are dropped
    as the pack is: for sure if their bucket has ended.
    """
    marked = [f for f in df.schema.fields if WATERMARK in f.metadata]
    if len(marked) != 1:
        return df  # Spark tells what is wrong
    instant = marked[0].name

    def cut(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        if not rows.num_rows:
            return
        order, starts, buckets, data = _packs(rows, bucket_s, instant)
        none = np.iinfo("int64").min
        at = rows[instant].cast(pa.int64()).fill_null(none).to_numpy()[order]
        latest = np.maximum.reduceat(at, starts)
        shard = rows["shard"].to_numpy()[order][starts]
        columns = [pa.array(shard, pa.int32()), pa.array(latest, pa.int64(), mask=latest == none).cast(rows[instant].type),
                   pa.array(buckets, pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", instant, "bucket", "data"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield from cut(held)
                held, n = [], 0
        if held:
            yield from cut(held)

    return df.mapInArrow(pack, StructType([
        StructField("shard", IntegerType()), marked[0], StructField("bucket", LongType()), StructField("data", BinaryType())]))


class _Keyed(StatefulProcessor):
    """A shard of keys: rows that wait in buckets for the watermark, and one value with the states of the shard's keys.

    A call to the state store costs far more than a row, so it is made per shard and bucket, not per key.
    """

    columns: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    bucket_s = BUCKET_S

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("s", "due long, data binary")
        # rows of a bucket come in parts, one per call, so that adding to a bucket does not read it
        self.parts = handle.getMapState("n", "bucket long", "parts int")
        self.waiting = handle.getMapState("w", "bucket long, part int", "data binary")

    def load(self) -> tuple[Any, int | None]:
        held = self.value.get()
        self.loaded = (held[0], bytes(held[1])) if held else None
        return self.states(self.loaded[1] if held else None), held[0] if held else None

    def save(self, states: Any, due: int | None) -> None:
        data = (due, self.stored(states)) if self.any(states) else None
        if data is None and self.loaded is not None:
            self.value.clear()
        elif data != self.loaded:
            self.value.update(data)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:  # one bounded frame after the other
            found: dict[int, list[bytes]] = {}
            if "data" in part and "at_s" not in part:
                buckets, packs = part["bucket"].tolist(), part["data"].tolist()
            else:
                _, _, buckets, packs = _packs(pa.Table.from_pandas(part, preserve_index=False), self.bucket_s)
            for own, pack in zip(buckets, packs):
                found.setdefault(int(own), []).append(pack)
            for own, packs in found.items():
                held = self.parts.getValue((own,))
                n = held[0] if held else 0
                self.waiting.updateValue((own, n), (_joined(packs),))
                self.parts.updateValue((own,), (n + 1,))
                if not n:
                    self.handle.registerTimer((own + 1) * self.bucket_s * 1000)
        yield from ()

    def _table(self, bucket: int) -> pa.Table | None:
        """Takes the rows of a bucket out of the state, in the order in which they came."""
        held, found = self.parts.getValue((bucket,)), []
        for part in range(held[0] if held else 0):
            found += _opened(self.waiting.getValue((bucket, part))[0])
            self.waiting.removeKey((bucket, part))
        if held:
            self.parts.removeKey((bucket,))
        return pa.concat_tables(found, promote_options="permissive").combine_chunks() if found else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The bucket that ends now: its rows, then whatever of the states has ended with it."""
        end_s = expiredTimerInfo.getExpiryTimeInMs() // 1000
        rows, (states, due) = self.taken(end_s // self.bucket_s - 1), self.load()
        due = due if due is not None and due > end_s else None  # a timer that stands for the end of a state
        states, out = self.applied(rows, end_s, states)
        passed_s = timerValues.getCurrentWatermarkInMs() // 1000
        ended_s = passed_s // self.bucket_s * self.bucket_s
        if self.any(states) and ended_s > end_s:
            # the watermark is past these buckets already, and a timer set now would wait for the next batch; where rows wait,
            # they come first, and their own timer follows in this batch
            ended_s = min([ended_s, *(bucket * self.bucket_s for (bucket,) in self.parts.keys())])
        states, first = self.settled(states, end_s, ended_s, out)
        if first is not None:
            after = int(first // self.bucket_s + 1) * self.bucket_s
            if after > passed_s and (due is None or after < due):
                due = after
                self.handle.registerTimer(due * 1000)
        self.save(states, due)
        yield from self.frame(out, max(end_s, passed_s) * 1000)

    def any(self, states: Any) -> bool:
        """Whether there are states to keep."""
        raise NotImplementedError

    def states(self, data: bytes | None) -> Any:
        raise NotImplementedError

    def stored(self, states: Any) -> bytes:
        raise NotImplementedError

    def taken(self, bucket: int) -> Any:
        raise NotImplementedError

    def applied(self, rows: Any, end_s: int, states: Any) -> tuple[Any, Any]:
        """States after the rows of a bucket, and what comes out."""
        raise NotImplementedError

    def settled(self, states: Any, end_s: int, ended_s: int, out: Any) -> tuple[Any, float | None]:
        """States that have not ended, and when the first of them will."""
        raise NotImplementedError

    def frame(self, out: Any, ready_ms: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Stepped(_Keyed):
    """Row after row, a dict of state per key."""

    def any(self, states):
        return bool(states)

    def states(self, data):
        return {tuple(k): s for k, s in json.loads(data)} if data else {}

    def stored(self, states):
        return json.dumps(list(states.items())).encode()

    def _take(self, bucket: int) -> list[dict]:
        table = self._table(bucket)
        rows = table.to_pylist() if table is not None else []
        rows.sort(key=lambda r: (r["at_s"], r.get("kind") or 0))
        return rows

    taken = _take

    def applied(self, rows, end_s, states):
        out: list[dict] = []
        self.release(rows, end_s, states, out)
        return states, out

    def settled(self, states, end_s, ended_s, out):
        first = None
        for of in list(states):
            state = states[of]
            while state and (ends := self.expiry(state)) is not None:
                if ends > end_s and ends >= ended_s:
                    first = ends if first is None else min(first, ends)
                    break
                self.expire(of, ends, state, out)
            if not state:
                del states[of]
        return states, first

    def frame(self, out, ready_ms):
        if out:
            yield pd.DataFrame(out, columns=list(self.columns))

    def release(self, rows, end_s, states, out) -> None:
        for row in rows:  # a step itself notices what has ended before its row
            of = tuple([row[k] for k in self.keys])
            self.step(of, row, states.setdefault(of, {}), out)

    def step(self, key, row, state, out) -> None:
        raise NotImplementedError

    def expiry(self, state) -> float | None:
        return None

    def expire(self, key, now_s, state, out) -> None:
        state.clear()


class _Columnar(_Keyed):
    """The rows of a bucket at once; states are rows with the instant ``ends`` at which they are forgotten."""

    def any(self, states):
        return states is not None and states.num_rows > 0

    def states(self, data):
        return pa.ipc.open_stream(data).read_all() if data else None

    def stored(self, states):
        return _bytes(states.combine_chunks().to_batches()[0])

    def taken(self, bucket):
        return self._table(bucket)

    def settled(self, states, end_s, ended_s, out):
        if not self.any(states):
            return None, None
        ends = states["ends"].to_numpy()
        kept = (ends > end_s) & (ends >= ended_s)
        if not kept.any():
            return None, None
        return states.filter(pa.array(kept)), ends[kept].min().item()

    def frame(self, out, ready_ms):
        """A following stateful operator is told when the rows came out; their own instants are behind the watermark."""
        if out is not None and out.num_rows:
            frame = out.to_pandas()
            if "ready_at" in self.columns:
                frame["ready_at"] = pd.Timestamp(ready_ms, unit="ms")
            yield frame[list(self.columns)]


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where all values are, missing ones equal to each other."""
    code, most = np.zeros(len(columns[0]), "int64"), 1
    for column in columns:
        found = column.combine_chunks().dictionary_encode(null_encoding="encode")
        if most * len(found.dictionary) >= 2**62:
            _, code = np.unique(code, return_inverse=True)
            most = len(code)
        code, most = code * len(found.dictionary) + found.indices.to_numpy(), most * len(found.dictionary)
    return code


def _run(
    df: DataFrame, keys: list[str], processor: _Keyed, schema: str, bucket_s: int, shards: int, event_time: str = ""
) -> DataFrame:
    """``shards`` bounds what one call holds, so it should grow with the stream: some ten thousand rows a shard and hour are well."""
    processor.bucket_s, processor.keys = bucket_s, tuple(keys)
    dealt = df if keys == ["shard"] else df.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    return _packed(dealt, bucket_s).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=event_time
    )


# --- lifecycle ---

EPISODES = (
    "trip_id string, reason string, emitted_s long, last_seen_s long, last_lat double, last_lon double,"
    "reappeared_s long, lat double, lon double, ghost_started_s long, ghost_duration_s double, backoff_overlapped boolean"
)
#: Rows of the lifecycle: a poll cycle, a trip in a cycle, a known outcome. Outcomes count after the cycle's positions.
CYCLE, TOUCH, OUTCOME = 0, 1, 2


class _Clock:
    """Poll cycles of a bucket with the running active seconds and backoffs; entry 0 is the last cycle before it."""

    def __init__(self, state: dict, cycles: list[dict]):
        self.at, self.active, self.backoffs = [state.get("at")], [state.get("active", 0)], [state.get("backoffs", 0)]
        for c in cycles:
            at, before = int(c["at_s"]), self.at[-1]
            if at == before:
                continue
            step = 0 if c["backoff"] or before is None else at - before
            self.at.append(at)
            self.active.append(self.active[-1] + step)
            self.backoffs.append(self.backoffs[-1] + bool(c["backoff"]))
        self.last = len(self.at) - 1
        self.place = {at: k for k, at in enumerate(self.at) if k}

    def state(self) -> dict:
        return dict(at=self.at[-1], active=self.active[-1], backoffs=self.backoffs[-1])


class _Trip:
    """One trip going through the cycles of a bucket."""

    def __init__(self, rules: Lifecycle, trip: str, state: dict, clock: _Clock, out: list[dict]):
        self.rules, self.trip, self.s, self.clock, self.out, self.done = rules, trip, state, clock, out, 0

    def emit(self, reason, k, start=None, upto=None, back=None):
        """``upto``: the last cycle whose backoff belongs to the gap."""
        fix, at = self.s.get("fix"), self.clock.at[k]
        overlapped = fix is not None and self.clock.backoffs[k if upto is None else upto] > fix["backoffs"]
        seen = fix or {}
        self.out.append(dict(
            trip_id=self.trip, reason=reason, emitted_s=at, last_seen_s=seen.get("at"), last_lat=seen.get("lat"), last_lon=seen.get("lon"),
            reappeared_s=at if back else None, lat=back["lat"] if back else None, lon=back["lon"] if back else None,
            ghost_started_s=start, ghost_duration_s=None if start is None else float(at - start), backoff_overlapped=overlapped,
        ))

    def outcome(self, k) -> str | None:
        """A stored outcome, unless a cycle before ``k`` found it too old."""
        stored = self.s.pop("resolved", None)
        return stored[0] if stored and self.clock.at[k - 1] - stored[1] < self.rules.retention_s else None

    def absent(self, until: int) -> None:
        """Cycles up to ``until`` that bring no position: ghost transition and eviction, at the cycle each is due."""
        first, self.done, s = self.done + 1, max(self.done, until), self.s
        if first > until or "touched" not in s:
            return
        gone = bisect_left(self.clock.at, s["touched"] + self.rules.max_age_s, first, until + 1)
        if s.get("fix") and not s["ghost"]:
            k = bisect_left(self.clock.active, s["fix"]["active"] + self.rules.coasting_s, first, until + 1)
            if k <= until and k <= gone:
                if (reason := self.outcome(k)) is not None:
                    self.emit(reason, k)
                    s.clear()
                    return
                s.update(ghost=True, start=self.clock.at[k])
        if gone <= until:
            if s["ghost"]:
                self.emit("timed_out", gone, s.get("start"))
            s.clear()

    def present(self, k: int, row: dict) -> None:
        self.absent(k - 1)
        s = self.s
        if row["has_position"]:
            if s.get("ghost"):
                self.emit("reappeared", k, s.get("start"), upto=k - 1, back=row)
            s.clear()
            s.update(touched=self.clock.at[k], ghost=False, fix=dict(
                at=self.clock.at[k], lat=row["lat"], lon=row["lon"], active=self.clock.active[k], backoffs=self.clock.backoffs[k]))
            self.done = k
            return
        s["touched"] = self.clock.at[k]
        if s.get("fix"):
            self.absent(k)
        elif (reason := self.outcome(k)) is not None:
            self.emit(reason, k)
            s.clear()
        else:
            s["ghost"] = True
        self.done = k

    def resolved(self, k: int, row: dict) -> None:
        self.absent(k)
        if self.s.get("ghost"):
            self.emit(row["reason"], k, self.s.get("start"))
            self.s.clear()
        else:
            self.s["resolved"] = [row["reason"], self.clock.at[k]]

    def play(self, rows: list[dict]) -> dict:
        seen = None
        for row in rows:
            k = self.clock.place.get(int(row["at_s"]))
            if k is None or (row["kind"] == TOUCH and k == seen):
                continue
            if row["kind"] == TOUCH:
                seen = k
                self.present(k, row)
            else:
                self.resolved(k, row)
        self.absent(self.clock.last)
        stored = self.s.get("resolved")
        if stored and self.clock.at[-1] - stored[1] >= self.rules.retention_s:
            del self.s["resolved"]
        return self.s


class Lifecycle(_Stepped):
    """Ghost episodes of the trips of one shard.

    Each shard gets every poll cycle, so it knows the active seconds at each: the clock of a missing trip stands still in a
    backoff, also while the trip itself brings no rows. A trip is looked at once per bucket, and jumps to the cycles at
    which it turns into a ghost or is forgotten. Its ghost start is kept when it happens. Nothing happens without
    cycles; a trip that is not touched for ``max_age_s`` leaves the state.
    """

    columns = tuple(c.strip().split(" ")[0] for c in EPISODES.split(","))

    def __init__(self, coasting_s: float, max_age_s: float, retention_s: float):
        self.coasting_s, self.max_age_s, self.retention_s = coasting_s, max_age_s, retention_s

    def release(self, rows, end_s, states, out):
        """The states are those of the trips; that of the clock has the empty key."""
        clock = _Clock(states.get((), {}), [r for r in rows if r["kind"] == CYCLE])
        if not clock.last:
            return
        by_trip: dict[tuple, list[dict]] = {}
        for r in sorted((r for r in rows if r["kind"] != CYCLE), key=lambda r: (r["at_s"], r["kind"], not r["has_position"])):
            by_trip.setdefault((r["trip_id"],), []).append(r)
        for of in (states.keys() | by_trip.keys()) - {()}:
            after = _Trip(self, of[0], states.get(of, {}), clock, out).play(by_trip.get(of, []))
            if after:
                states[of] = after
            else:
                states.pop(of, None)
        states[()] = clock.state()


def ghost_episodes(
    rows: DataFrame, *, coasting_s: float = COASTING_TIMEOUT_S, max_age_s: float = MAX_GHOST_AGE_S,
    retention_s: float = RESOLUTION_RETENTION_S, shards: int = SHARDS, bucket_s: int = BUCKET_S,
) -> DataFrame:
    """``rows``: kind, at_s, backoff (of cycles), trip_id, has_position, lat, lon (of touches), reason (of outcomes), with a watermark.

    Touches and outcomes carry the instant of their cycle. An episode still open when the stream stops is not reported.
    """
    own = F.array(F.pmod(F.xxhash64("trip_id"), F.lit(shards)).cast("int"))
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = rows.withColumn("shard", F.explode(F.when(F.col("kind") == CYCLE, everywhere).otherwise(own)))
    return _run(dealt, ["shard"], Lifecycle(coasting_s, max_age_s, retention_s), EPISODES, bucket_s, shards)


# --- completion ---

OUTCOMES = "trip_id string, route_id string, service_date string, finalized_s long, status string, actual_s long, delay_seconds long"


class Completion(_Stepped):
    """Outcome of one trip id from its rows (see ``completion.candidate_rows``)."""

    columns = tuple(c.strip().split(" ")[0] for c in OUTCOMES.split(","))

    def __init__(self, timeout_s: float, retention_s: float):
        self.timeout_s, self.retention_s = timeout_s, retention_s

    def step(self, key, row, state, out):
        at = row["at_s"]
        if state.get("touched") is not None and at - state["touched"] >= self.timeout_s:
            self.expire(key, state["touched"] + self.timeout_s, state, out)
        if state.get("final") is not None:
            if at - state["final"] <= self.retention_s:
                return
            state.clear()
        if state.get("touched") is None:
            if not row["has_terminus"]:
                return
            state.update(service_date=row["service_date"], route=None)
        state["touched"] = at
        state["route"] = row["route_id"] or state["route"]
        if row["outcome"] is not None:
            self._finish(key, at, row["outcome"], row["actual_s"], row["delay_seconds"], state, out)

    def _finish(self, key, at, status, actual, delay, state, out):
        out.append(dict(
            trip_id=key[0], route_id=state["route"], service_date=state["service_date"], finalized_s=int(at),
            status=status, actual_s=actual, delay_seconds=delay,
        ))
        state.clear()
        state["final"] = at

    def expiry(self, state):
        if state.get("final") is not None:
            return state["final"] + self.retention_s + 1  # a row of that very second is still passed over
        return state["touched"] + self.timeout_s if state.get("touched") is not None else None

    def expire(self, key, now_s, state, out):
        if state.get("final") is not None:
            state.clear()
        elif state.get("touched") is not None:
            self._finish(key, now_s, "undetermined_gap", None, None, state, out)


def completions(
    rows: DataFrame, *, timeout_s: float = UNDETERMINED_TIMEOUT_S, retention_s: float = FINALIZED_RETENTION_S,
    bucket_s: int = BUCKET_S, shards: int = SHARDS,
) -> DataFrame:
    """``rows``: trip_id, at_s, has_terminus, service_date (text), route_id, outcome, actual_s, delay_seconds."""
    return _run(rows, ["trip_id"], Completion(timeout_s, retention_s), OUTCOMES, bucket_s, shards)


# --- paced observations ---

PACED = "trip_id string, at_s long"


class Pacing(_Stepped):
    columns = ("trip_id", "at_s")

    def __init__(self, interval_s: float):
        self.interval_s = interval_s

    def step(self, key, row, state, out):
        if state.get("last") is None or row["at_s"] - state["last"] >= self.interval_s:
            out.append(dict(trip_id=key[0], at_s=row["at_s"]))
            state["last"] = row["at_s"]

    def expiry(self, state):
        return state["last"] + self.interval_s if state else None


def paced(rows: DataFrame, interval_s: float = OBSERVATION_INTERVAL_S, bucket_s: int = BUCKET_S, shards: int = SHARDS) -> DataFrame:
    return _run(rows, ["trip_id"], Pacing(interval_s), PACED, bucket_s, shards)


# --- headway: dwell per trip, then the last arrivals per group ---

HEADWAY_KEPT_S = 172_800  # a group without arrivals for so long starts anew

ARRIVALS = "trip_id string, stop_id string, route_id string, direction_id int, at_s long, ready_at timestamp"
HEADWAYS = "stop_id string, route_id string, direction_id int, trip_id string, at_s long, sample_size int, average_headway_seconds double"


class Dwell(_Columnar):
    """First row of each dwell; rows up to ``first_s`` only prime. A state is the stop and instant of a trip's last row."""

    columns = ("trip_id", "stop_id", "route_id", "direction_id", "at_s", "ready_at")

    def __init__(self, first_s: float, retention_s: float):
        self.first_s, self.retention_s = first_s, retention_s

    def applied(self, rows, end_s, states):
        if rows is None:
            return states, None
        stop = pc.if_else(pc.equal(rows["status"], "at"), rows["at_stop_id"], None)
        new = pa.table({"trip_id": rows["trip_id"], "at_s": rows["at_s"], "stop_id": stop, "route_id": rows["route_id"],
                        "direction_id": rows["direction_id"]})
        n = states.num_rows if states is not None else 0
        both = pa.concat_tables([*([states.drop_columns("ends")] if n else []), new], promote_options="permissive")
        trip, at, fresh = _codes(both["trip_id"]), both["at_s"].to_numpy(), np.arange(both.num_rows) >= n
        order = np.lexsort((at, fresh, trip))
        trip, at, fresh = trip[order], at[order], fresh[order]
        stops, dwells = _codes(both["stop_id"])[order], both["stop_id"].is_valid().to_numpy()[order]
        follows = np.zeros(len(order), bool)
        follows[1:] = trip[1:] == trip[:-1]
        same = follows.copy()
        same[1:] &= dwells[1:] & (stops[1:] == stops[:-1]) & (at[1:] - at[:-1] < self.retention_s)
        arrives = fresh & dwells & ~same & both["direction_id"].is_valid().to_numpy()[order]
        if arrives.any():
            arrives &= at > self.first_s
        last = dwells & ~np.append(follows[1:], False)
        kept = both.select(["trip_id", "at_s", "stop_id"]).take(order[last])
        return kept.append_column("ends", pa.array(at[last] + self.retention_s)), both.take(order[arrives])


class Headway(_Columnar):
    """Mean distance of the last arrivals of a group, forgotten ``keep_s`` after the last one. The states are a group's last arrivals."""

    columns = ("stop_id", "route_id", "direction_id", "trip_id", "at_s", "sample_size", "average_headway_seconds")

    def __init__(self, keep_s: float):
        self.keep_s = keep_s

    def applied(self, rows, end_s, states):
        if rows is None:
            return states, None
        group, back = ["stop_id", "route_id", "direction_id"], MAX_ARRIVALS - 1
        n = states.num_rows if states is not None else 0
        new = rows.select([*group, "trip_id", "at_s"])
        both = pa.concat_tables([*([states.drop_columns("ends")] if n else []), new], promote_options="permissive")
        # kept arrivals of a group come first, as they were
        place = np.arange(both.num_rows)
        by = pa.table({"group": _codes(*(both[c] for c in group)), "fresh": (place >= n).astype("int8"),
                       "at": np.where(place < n, place, both["at_s"].to_numpy()), "trip": both["trip_id"]})
        order = pc.sort_indices(by, sort_keys=[(c, "ascending") for c in by.column_names]).to_numpy()
        of, at, fresh = by["group"].to_numpy()[order], both["at_s"].to_numpy()[order], order >= n
        begins, starts = np.ones(len(order), bool), np.ones(len(order), bool)
        begins[1:] = of[1:] != of[:-1]
        starts[1:] = begins[1:] | (at[1:] - at[:-1] >= self.keep_s)
        start = np.maximum.accumulate(np.where(starts, place, 0))  # of the arrivals that are not forgotten
        size = np.minimum(place - start, back) + 1
        average = (at - at[place - size + 1]) / np.maximum(size - 1, 1)
        out = both.select(["trip_id", *group, "at_s"]).take(order[fresh])
        out = out.append_column("sample_size", pa.array(size[fresh].astype("int32"))).append_column(
            "average_headway_seconds", pa.array(average[fresh], mask=size[fresh] == 1))
        final = np.append(np.flatnonzero(begins)[1:], len(order))[np.cumsum(begins) - 1] - 1  # last row of the group
        kept = (place > final - back) & (place >= start[final])
        return both.select([*group, "at_s"]).take(order[kept]).append_column("ends", pa.array(at[final][kept] + self.keep_s)), out


def arrivals(
    states: DataFrame, first_s: float, retention_s: float = DWELL_RETENTION_S, bucket_s: int = BUCKET_S, shards: int = SHARDS
) -> DataFrame:
    """``states``: trip_id, at_s, status, at_stop_id, route_id, direction_id.

    ``ready_at`` tells when an arrival left this operator; it carries the watermark on to a following one.
    """
    return _run(states, ["trip_id"], Dwell(first_s, retention_s), ARRIVALS, bucket_s, shards, "ready_at")


def rolling_headways(
    arrived: DataFrame, keep_s: float = HEADWAY_KEPT_S, bucket_s: int = BUCKET_S, shards: int = SHARDS
) -> DataFrame:
    """``arrived``: the stream that ``arrivals`` gives, with buckets of the same size."""
    return _run(arrived, ["stop_id", "route_id", "direction_id"], Headway(keep_s), HEADWAYS, bucket_s, shards)


# --- edge triggers and header dedupe ---

RAISED = "trip_id string, discrepancy_type string, cycle long"
CHANGED = "feed string, at_s long, header long, content_s long, is_change boolean"


class Raised(_Stepped):
    """Forgets a pair after ``keep_s``, which must be more than a cycle."""

    columns = ("trip_id", "discrepancy_type", "cycle")

    def __init__(self, keep_s: float):
        self.keep_s = keep_s

    def step(self, key, row, state, out):
        if state.get("cycle") is None or row["cycle"] - state["cycle"] > 1:
            out.append(dict(trip_id=key[0], discrepancy_type=key[1], cycle=row["cycle"]))
        state.update(cycle=row["cycle"], at=row["at_s"])

    def expiry(self, state):
        return state["at"] + self.keep_s if state else None


class HeaderChange(_Stepped):
    """Whether a poll's header is new, and which poll's content stands for it.

    Works on light rows (feed, time, header), one per poll; a missing header is new.
    """

    columns = ("feed", "at_s", "header", "content_s", "is_change")

    def step(self, key, row, state, out):
        changed = row["header"] is None or "header" not in state or state["header"] != row["header"]
        if changed:
            state.update(header=row["header"], content=row["at_s"])
        out.append(dict(zip(self.columns, (key[0], row["at_s"], row["header"], state["content"], changed))))


def newly_raised(rows: DataFrame, keep_s: float = 3600, bucket_s: int = BUCKET_S, shards: int = SHARDS) -> DataFrame:
    """``rows``: trip_id, discrepancy_type, cycle, at_s."""
    return _run(rows, ["trip_id", "discrepancy_type"], Raised(keep_s), RAISED, bucket_s, shards)


def header_changes(polls: DataFrame, bucket_s: int = BUCKET_S, shards: int = SHARDS) -> DataFrame:
    """``polls``: feed, at_s, header."""
    return _run(polls, ["feed"], HeaderChange(), CHANGED, bucket_s, shards)
