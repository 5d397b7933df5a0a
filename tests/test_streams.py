import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from pairlens.operators import books, latency
from pairlens.streaming import live, pairs, reactions

T0 = datetime.datetime(2026, 3, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def drained(spark, rows, tmp_path, name="out"):
    """The rows of a stream after all that has come, in a folder that grows with each call."""
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.read.schema(rows.schema).parquet(str(tmp_path / name))


EVENT = "event_id long, event_ts timestamp, k string"
SHOT = "snapshot_ts timestamp, venue string, k string, seq long"


def made(seed, n):
    rng = random.Random(seed)
    events = [(i, at(rng.randrange(0, 6000) / 10), rng.choice(["a", "b", None])) for i in range(n)]
    shots = [(at(rng.randrange(0, 6000) / 10), rng.choice(["x", "y", None]), rng.choice(["a", "b", None]), rng.choice([i, None])) for i in range(n)]
    return events, shots


def in_parts(spark, rows, schema, path, order, parts):
    """Rows as files that come one after the other: each file reaches back a little behind the one before."""
    rng = random.Random(5)
    rows = sorted((r for r in rows if r[order] is not None), key=lambda r: r[order] + datetime.timedelta(seconds=rng.random() * 20))
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize(("keys", "parts"), [((), 1), (("k",), 1), ((), 3)])
def test_first_reactions_in_any_order_and_across_a_restart(spark, tmp_path, keys, parts):
    live.use_rocksdb(spark)
    events, shots = made(3, 250)
    cut = 300
    e, s = str(tmp_path / "e"), str(tmp_path / "s")

    def stream():
        found = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path) for path, schema in ((e, EVENT), (s, SHOT))]
        return reactions.first_reactions(*found, 5_000, keys, ["seq", "venue"], "60 seconds", 30_000, parts)

    # Two runs on one checkpoint: what the first holds back comes out in the second.
    for part in (lambda t: t < at(cut), lambda t: t >= at(cut)):
        in_parts(spark, [x for x in events if part(x[1])], EVENT, e, 1, 3)
        in_parts(spark, [x for x in shots if part(x[0])], SHOT, s, 0, 3)
        got = drained(spark, stream(), tmp_path)
    far = [(10_000, at(10**6), None)], [(at(10**6), None, None, None)]
    spark.createDataFrame(far[0], EVENT).write.mode("append").parquet(e)
    spark.createDataFrame(far[1], SHOT).write.mode("append").parquet(s)
    got = drained(spark, stream(), tmp_path)
    want = latency.first_reactions(spark.createDataFrame(events, EVENT), spark.createDataFrame(shots, SHOT), 5_000, keys, ["seq", "venue"])
    assert len({r["event_id"] for r in want.collect()}) > 50
    same = ["event_id", "event_ts", "latency_ms", "snapshot_ts", "venue", "seq"]
    assert sorted(map(repr, got.where("event_id < 10000").select(same).collect())) == sorted(map(repr, want.select(same).collect()))


def test_an_event_leaves_without_a_match_and_ties_go_by_seq(spark, tmp_path):
    live.use_rocksdb(spark)
    events = [(1, at(0), "a"), (2, at(50), "a"), (3, None, "a"), (4, at(10**6), "z")]
    shots = [(at(5), "late", "a", 9), (at(5), "first", "a", 2), (at(6), "x", "a", 1), (None, "y", "a", 0), (at(10**6), "z", "z", 0)]
    spark.createDataFrame(events, EVENT).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame(shots, SHOT).write.parquet(str(tmp_path / "s"))
    rows = reactions.first_reactions(spark.readStream.schema(EVENT).parquet(str(tmp_path / "e")), spark.readStream.schema(SHOT).parquet(str(tmp_path / "s")), 5_000, ["k"], ["seq"], "1 second")
    got = drained(spark, rows, tmp_path).collect()
    assert [(r["event_id"], r["venue"], r["latency_ms"], r["k"]) for r in got if r["event_id"] < 4] == [(1, "first", 5000.0, "a")]


CHANGE = "venue string, vmid string, ts timestamp, seq long, snapshot long, outcome string, price double, size double"
PAIR = "pair_key string, venue_a string, vmid_a string, venue_b string, vmid_b string, inverted boolean, date_a timestamp, date_b timestamp"
PAIRS = [
    ("p1", "polymarket", "m1", "kalshi", "m2", False, at(10**7), None),
    ("p2", "polymarket", "m1", "kalshi", "m3", True, None, None),
    ("p3", "kalshi", "m3", "polymarket", "m4", None, None, at(10**6)),
    ("p4", "kalshi", "none", "polymarket", "m1", False, None, None),
]


def changes(seed, n):
    rng = random.Random(seed)
    markets = [("polymarket", "m1"), ("kalshi", "m2"), ("kalshi", "m3"), ("polymarket", "m4"), ("polymarket", "other")]
    rows = []
    for i in range(n):
        venue, vmid = rng.choice(markets)
        price = rng.choice([None, 1.0, *[k / 100 for k in range(45, 54)]]) if rng.random() < 0.1 else rng.randrange(45, 54) / 100
        rows.append((venue, vmid, at(rng.randrange(0, 600)), i, i // 40 if rng.random() < 0.02 else -1, rng.choice(["yes", "no"]), price, float(rng.choice([0, 5, 10, 25]))))
    return rows


def books_at(rows, end):
    """Asks of every market from all changes before ``end``, one after the other."""
    found, numbers = {}, {}
    for venue, vmid, ts, _, snapshot, outcome, bid, size in sorted((r for r in rows if r[2] < end and r[6] is not None), key=lambda r: (r[2], r[3])):
        book = found.setdefault((venue, vmid), {})
        if snapshot >= 0 and numbers.get((venue, vmid)) != snapshot:
            book.clear()
            numbers[venue, vmid] = snapshot
        price = round(1 - bid, 6)
        level = ("no" if outcome == "yes" else "yes", price)
        if size <= 0:
            book.pop(level, None)
        elif 0 < price < 1:
            book[level] = size
    return [(*m, o, p, s) for m, book in found.items() for (o, p), s in book.items()]


def test_live_scan_of_all_pairs_equals_the_batch_at_each_interval(spark, tmp_path):
    live.use_rocksdb(spark)
    rows = changes(8, 300)
    path = str(tmp_path / "c")
    frame = spark.createDataFrame(PAIRS, PAIR)
    folder = str(tmp_path / "found")

    def run():
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(path)
        query = pairs.pair_books(stream, frame, 60_000, "ts", "90 seconds").writeStream.foreachBatch(pairs.scan_step(frame, lambda found, i: found.write.mode("overwrite").parquet(f"{folder}/batch={i}")))
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    in_parts(spark, [r for r in rows if r[2] < at(300)], CHANGE, path, 2, 2)
    run()
    in_parts(spark, [r for r in rows if r[2] >= at(300)], CHANGE, path, 2, 2)
    spark.createDataFrame([("polymarket", "m1", at(10**6), 0, -1, "yes", 0.5, 0.0)], CHANGE).write.mode("append").parquet(path)
    run()
    got = spark.read.parquet(folder).drop("batch")
    want = set()
    for k in range(1, 11):
        end = at(60 * k)
        levels = spark.createDataFrame(books_at(rows, end), "venue string, vmid string, outcome string, price double, size double")
        found = books.opportunities(frame, levels, F.lit(end)).collect()
        touched = {(r[0], r[1]) for r in rows if at(60 * (k - 1)) <= r[2] < end and r[6] is not None}
        want |= {repr(sorted({**r.asDict(), "interval_ms": round(end.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)}.items())) for r in found if {(r["venue_a"], r["vmid_a"]), (r["venue_b"], r["vmid_b"])} & touched}
    assert len(want) > 30
    assert sorted(repr(sorted(r.asDict().items())) for r in got.collect()) == sorted(want)


def test_live_scan_by_the_clock(spark, tmp_path):
    live.use_rocksdb(spark)
    rows = [("polymarket", "m1", T0, 1, -1, "yes", 0.5, 5.0), ("polymarket", "m1", T0, 2, -1, "no", 0.55, 5.0), ("kalshi", "m2", T0, 3, -1, "yes", 0.45, 5.0), ("kalshi", "m2", T0, 4, -1, "no", 0.5, 7.0)]
    path = str(tmp_path / "c")
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.parquet(path)
    frame = spark.createDataFrame(PAIRS, PAIR)
    got = []
    found = pairs.pair_books(spark.readStream.schema(CHANGE).parquet(path), frame).writeStream.foreachBatch(pairs.scan_step(frame, lambda f, i: got.extend(f.collect()), F.lit(T0)))
    query = found.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:
        end = time.monotonic() + 60
        while not got and time.monotonic() < end:
            time.sleep(0.3)
    finally:
        query.stop()
    assert {(r["pair_key"], r["side_a"], r["side_b"], r["ask_a"], r["ask_b"]) for r in got} == {("p1", "yes", "no", 0.45, 0.55), ("p1", "no", "yes", 0.5, 0.5)}


def test_pairs_without_rows(spark):
    levels, frame = spark.createDataFrame([], pairs.LEVEL), spark.createDataFrame(PAIRS, PAIR)
    assert pairs.opportunities_at(levels, frame).collect() == []
    sides = pairs.fanned_out(spark.createDataFrame(changes(1, 40), CHANGE), frame)
    assert {(r["vmid"], r["pair_key"], r["side"]) for r in sides.collect()} == {("m1", "p1", "a"), ("m1", "p2", "a"), ("m1", "p4", "b"), ("m2", "p1", "b"), ("m3", "p2", "b"), ("m3", "p3", "a"), ("m4", "p3", "b")}
