"""First reactions on a stream: each event takes the earliest snapshot of its window, or leaves.

Events and snapshots are one stream with one state per key, slot of time and part.  Either waits in
its state until the watermark has passed its window: then no earlier snapshot can come any more,
so the event goes out with the earliest one, or goes without, and the snapshot has
no event left to serve.  The rows are those of :func:`pairlens.operators.latency.first_reactions`, in any order of
arrival within the delay; what comes later than the delay is dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from pairlens.functions.text import micros

#: Text forms that keep microseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_EVENT, _SNAPSHOT = 0, 1


class FirstReaction(StatefulProcessor):
    """Pending events and snapshots of a key; ``step_ms`` is the grid that timers are rounded up to."""

    ROW = "at long, seq string, body string"
    OUT = "event string, snapshot string, gap long"

    def __init__(self, window_us: int, step_ms: int):
        self.window_us, self.step_ms = window_us, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.ROW)
        self.snapshots = handle.getListState("snapshots", self.ROW)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due: set[int] = set()
        for batch in rows:
            for kind, state in ((_EVENT, self.events), (_SNAPSHOT, self.snapshots)):
                own = batch[batch["kind"] == kind]
                if len(own):
                    state.appendList(list(zip(own["us"].tolist(), own["seq"].tolist(), own["body"].tolist(), strict=True)))
            # The first whole step at which the watermark is past the window.
            due.update((-(-(batch["us"] + self.window_us + 1) // (1000 * self.step_ms))).tolist())
        for step in due:
            self.handle.registerTimer(int(step) * self.step_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - self.window_us
        events = list(self.events.get())
        ready = [e for e in events if e[0] < passed]
        if ready:
            shots = sorted(self.snapshots.get(), key=lambda s: (s[0], _order(s[1])))
            at = np.array([s[0] for s in shots], np.int64)
            begun = np.array([e[0] for e in ready], np.int64)
            first = np.searchsorted(at, begun)
            hit = np.flatnonzero(first < len(at))
            gap = at[first[hit]] - begun[hit]
            hit, gap = hit[gap <= self.window_us], gap[gap <= self.window_us]
            if len(hit):
                yield pd.DataFrame({"event": [ready[i][2] for i in hit], "snapshot": [shots[first[i]][2] for i in hit], "gap": gap})
        _keep(self.events, events, passed)
        _keep(self.snapshots, list(self.snapshots.get()), passed)

    def close(self) -> None:
        pass


def _order(seq: str) -> list[tuple[bool, Any]]:
    """Nulls first, as Spark sorts."""
    return [(v is not None, v) for v in json.loads(seq).values()]


def _keep(state: Any, rows: list[tuple], passed: int) -> None:
    """Leaves in ``state`` the rows whose window is still open."""
    kept = [r for r in rows if r[0] >= passed]
    if len(kept) < len(rows):
        if kept:
            state.put(kept)
        else:
            state.clear()


def event_time(ts: str) -> Column:
    """``ts`` as the time that watermarks follow, within what pandas can hold."""
    first, last = (F.lit(day).cast("timestamp") for day in ("1700-01-01", "2260-01-01"))
    return F.greatest(first, F.least(last, F.col(ts).cast("timestamp")))


def first_reactions(events: DataFrame, snapshots: DataFrame, window_ms: int = 5_000, keys: Sequence[str] = (), seq: Sequence[str] = (), delay: str = "5 seconds", slot_ms: int = 60_000, parts: int = 1) -> DataFrame:
    """For each event of a stream the first snapshot 0 to ``window_ms`` later, with latency_ms; events without one go.

    ``events``: event_id, event_ts and the keys; ``snapshots``: snapshot_ts, the keys and ``seq`` for ties.
    A key's state is cut into slots of ``slot_ms`` and, for busy streams, the events of a slot into ``parts``; a
    snapshot goes to each part of the slot that it lies in and of the one that ends within its window.
    """
    slot_ms = max(slot_ms, window_ms)
    rest = [c for c in snapshots.columns if c not in keys]
    event = StructType([StructField("event_id", events.schema["event_id"].dataType), StructField("event_ts", events.schema["event_ts"].dataType), *[events.schema[k] for k in keys]])
    shot = StructType([snapshots.schema[c] for c in rest])

    def timed(rows: DataFrame, ts: str) -> DataFrame:
        return rows.where(F.col(ts).isNotNull()).withColumn("_at", event_time(ts)).withWatermark("_at", delay)

    def slot(us: Column) -> Column:
        return F.floor(us / F.lit(slot_ms * 1000))

    def row(rows: DataFrame, kind: int, ts: str, fields: Sequence[str], order: Sequence[str], slots: Column, part: Column) -> DataFrame:
        def text(names: Sequence[str]) -> Column:
            return F.to_json(F.struct(*names), {**_TIMES, "ignoreNullFields": "false"}) if names else F.lit("{}")

        found = rows.select("_at", *keys, micros(ts).alias("us"), F.lit(kind).alias("kind"), text(order).alias("seq"), text(fields).alias("body"), F.explode(slots).alias("_slot"))
        return found.withColumn("_part", F.explode(part))

    at_event, at_shot = micros("event_ts"), micros("snapshot_ts")
    left = row(timed(events, "event_ts"), _EVENT, "event_ts", event.names, [], F.array(slot(at_event)), F.array(F.pmod(F.xxhash64("body"), F.lit(parts)).cast("int")))
    right = row(timed(snapshots, "snapshot_ts"), _SNAPSHOT, "snapshot_ts", rest, seq, F.array_distinct(F.array(slot(at_shot), slot(at_shot - window_ms * 1000))), F.sequence(F.lit(0), F.lit(parts - 1)))
    processor = FirstReaction(window_ms * 1000, max(1, window_ms // 2))
    found = left.unionByName(right).groupBy(*keys, "_slot", "_part").transformWithStateInPandas(processor, outputStructType=FirstReaction.OUT, outputMode="append", timeMode="EventTime")
    read = found.select(F.from_json("event", event, _TIMES).alias("_e"), F.from_json("snapshot", shot, _TIMES).alias("_s"), "gap")
    return read.select("_e.event_id", "_e.event_ts", *[F.col(f"_e.{k}") for k in keys], (F.col("gap") / 1000.0).alias("latency_ms"), *[F.col(f"_s.{c}") for c in rest])
