"""Streaming twins of the batch operators.

State that needs a time to live or a map uses ``transformWithState`` (set the session's
state store to RocksDB, see :func:`use_rocksdb`); the rest are watermarked aggregations and
joins.  Checkpoints replace reconnecting and draining: stop a query and start it again.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from pairlens.config import Settings
from pairlens.functions.text import micros
from pairlens.operators import books as book_ops

log = logging.getLogger(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstInTtl(StatefulProcessor):
    """Passes the first row of a key; state forgets the key after the time to live, which later rows don't extend."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for batch in rows:
            if not known and len(batch):
                known = True
                self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
                yield batch.iloc[:1]

    def close(self) -> None:
        pass


def ttl_dedup(events: DataFrame, keys: Sequence[str], ttl_seconds: int = 3600) -> DataFrame:
    """The first row of each key within the time to live, by processing time."""
    return events.groupBy(*keys).transformWithStateInPandas(FirstInTtl(ttl_seconds * 1000), outputStructType=events.schema, outputMode="append", timeMode="ProcessingTime")


def distinct_events(events: DataFrame, id_column: str, ts: str, delay: str = "5 seconds") -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_column])


class BookState(StatefulProcessor):
    """Keeps the asks of one market as price to size and hands out the book after each batch.

    A row is a level (seq, outcome, bid price, size): the bid of one outcome is an ask of
    the other; size 0 takes the level away.  ``snapshot`` rows come with a new book: the
    first row of a snapshot number clears what was there.
    """

    SCHEMA = "venue string, vmid string, outcome string, price double, size double, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A book is read and written whole: every call to the state is a message to the JVM.
        self.levels = handle.getListState("levels", "outcome string, price double, size double")
        self.snapshot = handle.getValueState("snapshot", "number long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changes: list[tuple] = []
        for batch in rows:
            changes.extend(zip(*(batch[c].tolist() for c in ("seq", "snapshot", "outcome", "price", "size")), strict=True))
        changes.sort(key=lambda c: c[0])
        levels = {(o, p): s for o, p, s in self.levels.get()}
        known = number = None
        if any(c[1] >= 0 for c in changes):
            known = number = self.snapshot.get()[0] if self.snapshot.exists() else None
        for _, snapshot, outcome, bid, size in changes:
            if snapshot >= 0 and number != snapshot:
                levels.clear()
                number = int(snapshot)
            price = round(1.0 - bid, 6)
            level = ("no" if outcome == "yes" else "yes", price)
            if size <= 0:
                levels.pop(level, None)
            elif 0 < price < 1:
                levels[level] = float(size)
        if number != known:
            self.snapshot.update((number,))
        book = sorted((o, p, s) for (o, p), s in levels.items())
        if book:
            self.levels.put(book)
        else:
            self.levels.clear()
        if book:
            outcomes, prices, sizes = map(list, zip(*book, strict=True))
            n = len(book)
            yield pd.DataFrame({"venue": [key[0]] * n, "vmid": [key[1]] * n, "outcome": outcomes, "price": prices, "size": sizes, "seq": [int(changes[-1][0])] * n})

    def close(self) -> None:
        pass


def books(deltas: DataFrame) -> DataFrame:
    """Asks of every market that a micro-batch touched, from (venue, vmid, seq, snapshot, outcome, price, size)."""
    return deltas.groupBy("venue", "vmid").transformWithStateInPandas(BookState(), outputStructType=BookState.SCHEMA, outputMode="update", timeMode="None")


def with_refresh(deltas: DataFrame, fetched: DataFrame, every_seconds: int = 30) -> DataFrame:
    """Deltas together with whole books fetched now and then, as one input of :func:`books`.

    ``fetched``: levels (venue, vmid, seq, outcome, bid price, size) with taken_at; all levels of
    a market within an interval are one snapshot, which clears what was there.  An empty book is
    one level of size 0.
    """
    number = F.floor(micros("taken_at") / (every_seconds * 1_000_000))
    levels = fetched.select("venue", "vmid", "seq", number.alias("snapshot"), "outcome", "price", "size")
    return deltas.select(levels.columns).union(levels)


def still_fresh(rows: DataFrame, ts: str, seconds: float = 5.0, now: Column | None = None) -> DataFrame:
    """Rows no older than some seconds of wall-clock time when they are processed; rows without a time are stale."""
    at = micros(now if now is not None else F.current_timestamp())
    return rows.where(micros(ts) >= at - int(seconds * 1_000_000))


_DELTA = "type string, msg struct<market_ticker:string,yes:string,no:string>"


def delta_levels(messages: DataFrame) -> DataFrame:
    """Levels of delta messages (payload, seq): prices in cents, both outcomes."""
    pairs = "array<array<double>>"

    def side(outcome: str) -> Column:
        raw = F.coalesce(F.from_json(f"msg.{outcome}", pairs), F.array().cast(pairs))
        return F.transform(raw, lambda x: F.struct(F.lit(outcome).alias("outcome"), (x[0] / 100.0).alias("price"), x[1].alias("size")))

    # As rows of a generator a message is parsed once; as a column it would be for every use, and so would lists behind
    # an inner explode, which Spark first asks for their size.
    # Text without the word holds no delta, unless an escape hides it.
    likely = F.col("payload").contains("orderbook_delta") | F.col("payload").contains("\\")
    rows = messages.where(likely).select("seq", F.inline_outer(F.array(F.from_json("payload", _DELTA)))).where("type = 'orderbook_delta' AND msg.market_ticker <> ''")
    levels = rows.select(F.lit("kalshi").alias("venue"), F.col("msg.market_ticker").alias("vmid"), "seq", F.lit(-1).cast("long").alias("snapshot"), F.explode_outer(F.concat(side("yes"), side("no"))).alias("x"))
    return levels.where("x IS NOT NULL").select("venue", "vmid", "seq", "snapshot", "x.*")


def throttled(rows: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], every: str = "250 milliseconds", delay: str | None = None) -> DataFrame:
    """The last row of each key in each interval."""
    source = rows.withWatermark(ts, delay) if delay else rows
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("x")
    return source.groupBy(F.window(ts, every).alias("_w"), *keys).agg(last).select(*keys, F.col("_w.start").alias("interval_start"), "x.*")


def reactions(events: DataFrame, snapshots: DataFrame, window_ms: int = 5_000, delay: str = "5 seconds") -> DataFrame:
    """Every snapshot within the window behind an event; :func:`first_of` keeps one an event.

    ``events``: event_id, event_ts; ``snapshots``: snapshot_ts, venue, market_id.  The
    streaming join needs an equality, so both sides carry the time bucket.
    """
    width = window_ms * 1000
    bucket = lambda ts: F.floor(micros(ts) / F.lit(width))
    left = events.withWatermark("event_ts", delay).withColumn("_b", F.explode(F.array(bucket("event_ts"), bucket("event_ts") + 1))).alias("e")
    right = snapshots.withWatermark("snapshot_ts", delay).withColumn("_b", bucket("snapshot_ts")).alias("s")
    within = F.expr(f"e._b = s._b AND s.snapshot_ts >= e.event_ts AND s.snapshot_ts <= e.event_ts + INTERVAL {window_ms / 1000} SECONDS")
    gap = (micros("snapshot_ts") - micros("event_ts")) / 1000.0
    return left.join(right, within).select("event_id", "event_ts", "snapshot_ts", "venue", "market_id", gap.alias("latency_ms"))


def first_of(matches: DataFrame) -> DataFrame:
    """For each event the match with the least latency; for ``foreachBatch`` or a finished stream."""
    rest = [c for c in matches.columns if c != "event_id"]
    return matches.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct("latency_ms", "venue", "market_id")).alias("x")).select("event_id", "x.*")


class Health(StreamingQueryListener):
    """Rows and rates of the last progress of each query, and how it ended."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self.clock = clock
        self.progress: dict[str, dict[str, Any]] = {}

    def _entry(self, run_id: Any) -> dict[str, Any]:
        return self.progress.setdefault(str(run_id), {"rows": 0, "state": "running", "heard": self.clock()})

    def onQueryStarted(self, event: Any) -> None:
        self._entry(event.runId)

    def onQueryProgress(self, event: Any) -> None:
        own = self._entry(event.progress.runId)
        own["rows"] += event.progress.numInputRows
        own["rate"] = event.progress.processedRowsPerSecond
        own["heard"] = self.clock()

    def onQueryIdle(self, event: Any) -> None:
        self._entry(event.runId)["heard"] = self.clock()

    def onQueryTerminated(self, event: Any) -> None:
        self._entry(event.runId)["state"] = "failed" if event.exception else "stopped"

    def beat(self, silent_after: float = 60.0) -> dict[str, Any]:
        """What a heartbeat reports: queries by state, all rows, and running queries not heard of for a while."""
        states = [own["state"] for own in self.progress.values()]
        silent = sorted(k for k, own in self.progress.items() if own["state"] == "running" and self.clock() - own["heard"] > silent_after)
        return {"status": "running" if "running" in states else "stopped", **{s: states.count(s) for s in ("running", "stopped", "failed")}, "rows": sum(own["rows"] for own in self.progress.values()), "silent": silent}


class PairWatch:
    """For ``foreachBatch`` on :func:`books`: keeps the last books of the two markets of one pair and
    hands each opportunity to a callback whenever one of them changes.

    ``pair``: pair_key, venue_a, vmid_a, venue_b, vmid_b, inverted, date_a, date_b.  The driver
    holds two books and no more; after a restart a side counts again from its next change on.  A
    callback that fails is logged and stops nothing.
    """

    PAIR = "pair_key string, venue_a string, vmid_a string, venue_b string, vmid_b string, inverted boolean, date_a timestamp, date_b timestamp"
    LEVEL = "venue string, vmid string, outcome string, price double, size double"

    def __init__(self, pair: tuple, on_opportunity: Callable[[dict[str, Any]], None], settings: Settings = Settings(), as_of: Column | None = None):
        self.pair, self.call, self.settings, self.as_of = pair, on_opportunity, settings, as_of
        self.sides = {(pair[1], pair[2]): [], (pair[3], pair[4]): []}
        self.updates = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (va, ma), (vb, mb) = self.sides
        mine = ((F.col("venue") == va) & (F.col("vmid") == ma)) | ((F.col("venue") == vb) & (F.col("vmid") == mb))
        changed: dict[tuple, list[tuple]] = {}
        for r in batch.where(mine).select("venue", "vmid", "outcome", "price", "size").collect():
            changed.setdefault((r["venue"], r["vmid"]), []).append(tuple(r))
        if not changed:
            return
        self.updates += len(changed)
        self.sides.update(changed)
        if not all(self.sides.values()):
            return
        levels = spark.createDataFrame([x for side in self.sides.values() for x in side], self.LEVEL)
        found = book_ops.opportunities(spark.createDataFrame([self.pair], self.PAIR), levels, self.as_of if self.as_of is not None else F.current_timestamp(), self.settings)
        for r in found.collect():
            try:
                self.call(r.asDict())
            except Exception:
                log.exception("the callback failed on %s", r["pair_key"])


class Rebroadcast:
    """For ``writeStream.foreach``: every row as JSON to each client that ``connect`` gives in the task.

    A client is a function of the text; one that fails gets no more rows of the task.
    """

    def __init__(self, connect: Callable[[], Sequence[Callable[[str], None]]]):
        self.connect = connect

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.clients = list(self.connect())
        return True

    def process(self, row: Any) -> None:
        line = json.dumps(row.asDict(recursive=True), default=str)
        for send in list(self.clients):
            try:
                send(line)
            except Exception:
                self.clients.remove(send)

    def close(self, error: Exception | None) -> None:
        self.clients = []


def bounded_files(spark: SparkSession, path: str, schema: str, files: int = 100, format: str = "json") -> DataFrame:
    """A stream over a folder whose batches take some files at most: what comes faster waits in the folder, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(path)


def start_batches(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Runs ``step`` on what came in each interval; a source's own limits (``maxFilesPerTrigger``) bound a batch, and nothing is dropped."""
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain(query: StreamingQuery) -> None:
    """Ends a query when all that has come is processed; started again on its checkpoint it goes on from there."""
    query.processAllAvailable()
    query.stop()
