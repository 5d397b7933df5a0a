"""A live scan over all pairs: a changed book recomputes its pairs, each at most once an interval.

Changes of books fan out to the pairs that hold their market through a join with the table of
pairs, into a state keyed by pair that keeps the books of both sides.  At the end of an interval
a pair that changed hands out both books, and :func:`opportunities_at` computes on all of them
together, as a batch that Spark distributes; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairlens.config import Settings
from pairlens.functions.text import micros
from pairlens.operators import books
from pairlens.streaming.reactions import event_time

#: Columns of the levels that a pair hands out at the end of an interval.
LEVEL = "pair_key string, side string, outcome string, price double, size double, interval_ms long"
_CHANGE = "side string, us long, seq long, snapshot long, outcome string, price double, size double"


class Book:
    """The asks of a pair's two sides; changes are bids of the other outcome, a size of zero takes a level away."""

    def __init__(self, levels: Iterator[tuple], snapshots: Iterator[tuple]):
        self.levels = {tuple(x[:3]): x[3] for x in levels}
        self.snapshots = dict(snapshots)

    def apply(self, changes: list[tuple]) -> None:
        for side, _, _, snapshot, outcome, bid, size in changes:
            # The first row of a whole book clears what was there.
            if snapshot >= 0 and self.snapshots.get(side) != snapshot:
                self.levels = {k: v for k, v in self.levels.items() if k[0] != side}
                self.snapshots[side] = snapshot
            price = round(1.0 - bid, 6)
            level = (side, "no" if outcome == "yes" else "yes", price)
            if size <= 0:
                self.levels.pop(level, None)
            elif 0 < price < 1:
                self.levels[level] = size

    def rows(self) -> list[tuple]:
        return sorted((*k, v) for k, v in self.levels.items())

    def whole(self) -> bool:
        return len({k[0] for k in self.levels}) == 2


class PairBooks(StatefulProcessor):
    """Hands out both books of a pair at the end of each interval in which one of them changed.

    By event time (``event_time``) changes wait until the watermark has passed their interval and count in
    order of time and ``seq``, so the rows don't depend on how the stream was cut into batches.  By
    processing time they count in order of arrival, and an interval begins with the first change.
    """

    def __init__(self, interval_ms: int = 250, event_time: bool = False):
        self.interval_ms, self.event_time = interval_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getListState("levels", "side string, outcome string, price double, size double")
        self.snapshots = handle.getListState("snapshots", "side string, number long")
        self.waiting = handle.getListState("waiting", _CHANGE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _CHANGE.split(", ")]
        pending = not self.event_time and self.waiting.exists()
        ends: set[int] = set()
        for batch in rows:
            self.waiting.appendList(list(zip(*(batch[c].tolist() for c in names), strict=True)))
            ends.update((batch["us"] // (1000 * self.interval_ms) + 1).tolist())
        if self.event_time:
            for end in ends:
                self.handle.registerTimer(int(end) * self.interval_ms)
        elif not pending:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        changes = sorted(self.waiting.get(), key=lambda c: (c[1], c[2])) if self.event_time else list(self.waiting.get())
        if self.event_time:
            # All intervals that are over, in their order, whichever timer comes first.
            passed = timerValues.getCurrentWatermarkInMs() // self.interval_ms
            due = [c for c in changes if c[1] // (1000 * self.interval_ms) < passed]
            rest = changes[len(due) :]
            runs: dict[int, list[tuple]] = {}
            for c in due:
                runs.setdefault((c[1] // (1000 * self.interval_ms) + 1) * self.interval_ms, []).append(c)
        else:
            rest, runs = [], {timerValues.getCurrentProcessingTimeInMs(): changes} if changes else {}
        if not runs:
            return
        book = Book(self.levels.get(), self.snapshots.get())
        # All intervals go out as one frame: a frame costs far more than its rows.
        found: list[tuple] = []
        for end, run in runs.items():
            book.apply(run)
            if book.whole():
                found += [(key[0], *level, end) for level in book.rows()]
        if found:
            yield pd.DataFrame(dict(zip((c.split()[0] for c in LEVEL.split(", ")), map(list, zip(*found, strict=True)), strict=True)))
        for state, now in ((self.levels, book.rows()), (self.snapshots, sorted(book.snapshots.items())), (self.waiting, rest)):
            state.put(now) if now else state.clear()

    def close(self) -> None:
        pass


def fanned_out(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``changes`` (venue, vmid, and others) once for each side of a pair that is their market, with pair_key and side."""
    sides = [pairs.select("pair_key", F.lit(s).alias("side"), F.col(f"venue_{s}").alias("venue"), F.col(f"vmid_{s}").alias("vmid")) for s in "ab"]
    return changes.join(sides[0].union(sides[1]), ["venue", "vmid"])


def pair_books(changes: DataFrame, pairs: DataFrame, interval_ms: int = 250, ts: str | None = None, delay: str = "5 seconds") -> DataFrame:
    """A stream of both books (LEVEL) of each pair that changed, interval by interval.

    ``changes``: venue, vmid, seq, snapshot, outcome, price (bid), size as of :func:`pairlens.streaming.live.books`.
    With ``ts`` intervals are of that time, else of the clock.
    """
    rows = changes.where("outcome IS NOT NULL AND price IS NOT NULL AND size IS NOT NULL")
    if ts:
        rows = rows.where(F.col(ts).isNotNull()).withColumn("_at", event_time(ts)).withWatermark("_at", delay).withColumn("us", micros(ts))
    else:
        rows = rows.withColumns({"_at": F.lit(None).cast("timestamp"), "us": F.lit(0).cast("long")})
    rows = fanned_out(rows, pairs).select("pair_key", "_at", "side", "us", F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), F.coalesce("snapshot", F.lit(-1)).cast("long").alias("snapshot"), "outcome", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    keyed = (rows if ts else rows.drop("_at")).groupBy("pair_key")
    return keyed.transformWithStateInPandas(PairBooks(interval_ms, bool(ts)), outputStructType=LEVEL, outputMode="append", timeMode="EventTime" if ts else "ProcessingTime")


def opportunities_at(levels: DataFrame, pairs: DataFrame, as_of: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """The opportunities of each pair and interval in ``levels`` (LEVEL), with interval_ms.

    ``pairs``: as of :func:`pairlens.operators.books.opportunities`.  Without ``as_of`` days count from the interval's end.
    """
    run = F.to_json(F.struct("pair_key", "interval_ms"))
    runs = pairs.join(levels.select("pair_key", "interval_ms").distinct(), "pair_key").withColumn("run", run)
    # Each run has books of its own: a market may stand in several pairs, and in several intervals.
    named = runs.select(F.col("run").alias("pair_key"), *[c for s in "ab" for c in (f"venue_{s}", F.concat(F.lit(s), "run").alias(f"vmid_{s}"))], "inverted", "date_a", "date_b", F.timestamp_millis("interval_ms").alias("interval_end"))
    venue = F.when(F.col("side") == "a", F.col("venue_a")).otherwise(F.col("venue_b"))
    asks = levels.join(pairs.select("pair_key", "venue_a", "venue_b"), "pair_key").select(venue.alias("venue"), F.concat("side", run).alias("vmid"), "outcome", "price", "size")
    found = books.opportunities(named, asks, F.col("interval_end") if as_of is None else as_of, settings)
    own = runs.select("run", "pair_key", "interval_ms", "vmid_a", "vmid_b")
    return found.drop("vmid_a", "vmid_b").withColumnRenamed("pair_key", "run").join(own, "run").drop("run")


def scan_step(pairs: DataFrame, write: Callable[[DataFrame, int], None], as_of: Column | None = None, settings: Settings = Settings()) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on :func:`pair_books`: ``write`` gets the opportunities of each batch with its id."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                write(opportunities_at(batch, pairs, as_of, settings), batch_id)
        finally:
            batch.unpersist()

    return step
