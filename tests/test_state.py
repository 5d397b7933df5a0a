import datetime
import random

import pytest
from pyspark.sql import functions as F

from pairlens import config
from pairlens.operators import dedup, latency, persist, reports, rerank, retrieve
from pairlens.plans import matching, spreads
from pairlens.streaming import live

T0 = datetime.datetime(2026, 3, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_ttl_dedup_equals_a_fold(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), at(rng.randrange(0, 20000))) for i in range(400)] + [(900, None, at(5)), (901, None, at(9))]
    kept, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() > 3600:
            last[k] = t
            kept.add(i)
    df = spark.createDataFrame(rows, "i long, k string, t timestamp")
    assert {r["i"] for r in dedup.ttl_dedup(df, ["k"], "t", ["i"]).collect()} == kept
    assert dedup.ttl_dedup(df, ["k"], "t", ["i"], None).count() == 4
    assert dedup.ttl_dedup(df.limit(0), ["k"], "t", ["i"]).count() == 0


def test_ttl_dedup_of_missing_times_and_a_hot_key(spark):
    rows = [(1, "k", None), (2, "k", None), (3, "k", at(0)), (4, "k", at(1))] + [(100 + i, "hot", at(i)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "i long, k string, t timestamp")
    got = {r["i"] for r in dedup.ttl_dedup(df, ["k"], "t", ["i"]).collect()}
    assert got == {1, 2, 3} | {100, 3701, 7302, 10903}


def test_upsert_and_versions(spark):
    schema = "id string, venue string, vmid string, title string, text_hash string, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("1", "k", "a", "A", "h1", T0, T0), ("2", "k", "b", "B", None, T0, T0), ("3", "k", "c", "C", "h3", T0, T0)], schema)
    new = spark.createDataFrame([("9", "k", "a", "A2", "h1"), ("8", "k", "b", "B2", "h2"), ("7", "p", "z", "Z", None)], "id string, venue string, vmid string, title string, text_hash string")
    got = {r["vmid"]: r for r in persist.upsert(old, new, ["venue", "vmid"], "text_hash", F.lit(at(60))).collect()}
    assert {k: (r["id"], r["title"], r["updated_at"]) for k, r in got.items()} == {"a": ("1", "A", T0), "b": ("2", "B2", at(60)), "c": ("3", "C", T0), "z": ("7", "Z", at(60))}
    assert got["z"]["created_at"] == at(60)
    v = persist.versioned(spark.createDataFrame([("p", 1)], "pair_key string, seq int"), spark.createDataFrame([("p", 2), ("p", 3), ("q", 1)], "pair_key string, seq int"), "pair_key", ["seq"])
    assert sorted((r["pair_key"], r["seq"], r["version"], r["is_current"]) for r in v.collect()) == [("p", 1, 1, False), ("p", 2, 2, False), ("p", 3, 3, True), ("q", 1, 1, True)]
    ids = spark.createDataFrame([("AB" * 32,), ("short",)], "h string").select(persist.point_id(F.col("h")).alias("p")).collect()
    assert ids[0]["p"] == "abababab-abab-abab-abab-abababababab" and len(ids[1]["p"]) == 36
    assert persist.change_log(v, "pair_key", F.lit(T0)).count() == 2


def test_batch_writer(spark, tmp_path):
    batch = spark.range(3)
    calls, waits = [], []

    def flaky(df, i):
        calls.append(i)
        if len(calls) < 3:
            raise OSError("busy")

    writer = persist.BatchWriter([flaky, persist.append_once(str(tmp_path / "out"))], str(tmp_path / "dead"), sleep=waits.append)
    writer(batch, 4)
    assert len(calls) == 3 and waits == [1, 2] and spark.read.parquet(str(tmp_path / "out")).count() == 3
    fatal = persist.BatchWriter([lambda df, i: 1 / 0], str(tmp_path / "dead"), transient=lambda e: False, sleep=waits.append)
    fatal(batch, 5)
    assert len(waits) == 2 and spark.read.json(str(tmp_path / "dead")).count() == 3
    fatal(batch.limit(0), 6)
    lines = persist.audit_lines(batch, "latency", F.lit("info"), F.lit(T0))
    persist.write_audit(lines, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).where("category = 'latency' AND severity = 'info'").count() == 3


def test_reactions(spark):
    events = spark.createDataFrame([(1, at(10)), (2, at(20)), (3, at(100))], "event_id long, event_ts timestamp")
    snaps = spark.createDataFrame([(at(9.9), "k", 0), (at(10), "p", 1), (at(15), "k", 2), (at(25), "k", 4), (at(25), "p", 3), (at(105.001), "k", 5)], "snapshot_ts timestamp, venue string, seq long")
    got = {r["event_id"]: (r["latency_ms"], r["venue"]) for r in latency.first_reactions(events, snaps, seq=["seq"]).collect()}
    assert got == {1: (0.0, "p"), 2: (5000.0, "p")}
    samples = spark.createDataFrame([(i, float(x)) for i, x in enumerate([5, 1, 4, 2])], "i long, latency_ms double")
    assert tuple(latency.latency_stats(samples, ["i"]).first()) == (4, 1.0, 5.0, 3.0, 4.0)
    assert latency.latency_stats(samples, ["i"], 1).first()["mean"] == 2.0
    ema = spark.range(1).select(latency.moving_average(F.array(F.lit(10.0), F.lit(20.0))).alias("x")).first()["x"]
    assert ema == pytest.approx(11.0)


def test_reports(spark):
    rows = [("a", at(1), 1, 0.02, 0.0), ("a", at(2), 2, 0.05, 0.01), ("a", at(3), 3, 0.05, -0.1), ("b", at(1), 4, -0.1, -0.2)]
    s = spark.createDataFrame(rows, "pair_key string, timestamp timestamp, seq long, gross_edge double, net_edge double")
    stats = {r["pair_key"]: r for r in reports.series_stats(s, "pair_key", "timestamp", "gross_edge", ["seq"]).collect()}
    assert stats["a"]["max_edge_time"] == at(2) and stats["a"]["min_edge"] == 0.02 and stats["b"]["n"] == 1
    assert {r["pair_key"]: r["status"] for r in reports.live_status(s, "pair_key", ["seq"]).collect()} == {"a": "EDGE", "b": "---"}
    assert reports.chart_panels(s).count() == 8
    opps = spark.createDataFrame([("a", "yes", "no", 0.4, 0.5, 0.1, 0.08, 4.0, 0.2), ("a", "no", "yes", 0.6, 0.45, -0.05, -0.06, 0.0, 0.0)], "pair_key string, side_a string, side_b string, ask_a double, ask_b double, gross_edge double, net_profit_1 double, pnl_at_budget double, daily_yield_bps double")
    tops = spark.createDataFrame([("a", 0.4, 0.5), ("b", 0.7, 0.6)], "pair_key string, ask_a double, ask_b double")
    snap = {r["pair_key"]: r for r in reports.best_snapshots(opps, tops, F.lit(T0)).collect()}
    assert snap["a"]["net_edge"] == 0.08 and snap["b"]["gross_edge"] == pytest.approx(-0.3) and snap["b"]["net_edge"] == 0.0


def test_similar_in_many_blocks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["k", "p", None]), [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(500, "k", None), (501, "k", [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, venue string, v array<float>")
    one = {tuple(r) for r in retrieve.similar(df, "id", "venue", "v", 5, 0.2).collect()}
    many = {tuple(r) for r in retrieve.similar(df, "id", "venue", "v", 5, 0.2, block_rows=30).collect()}
    assert one == many and max(r[1] for r in one) == 5


def test_match_and_scan_end_to_end(spark):
    def event(venue, id_, title, seconds, criteria="According to Coinbase the price counts."):
        return (venue, id_, "created", title, None, criteria, datetime.datetime(2026, 12, 31), [("1", "Yes"), ("2", "No")], None, at(seconds))

    from pairlens.schemas import MARKET_EVENT

    rows = [event("kalshi", "K1", "Will Bitcoin close above $100k in December", 1), event("polymarket", "P1", "Will Bitcoin close above $100k in December", 2), event("polymarket", "P1", "Changed later", 3), event("polymarket", "P2", "Will it rain in Paris on Sunday", 4, ""), event("opinion", "O1", "Will Bitcoin close above $100k in December", 5)]
    got = matching.match(spark.createDataFrame(rows, MARKET_EVENT)).collect()
    assert [(r["pair_key"], r["verdict"]) for r in got] == [("kalshi:K1_polymarket:P1", "equivalent")]
    assert got[0]["market_a_id"] == "polymarket:P1" and got[0]["outcome_mapping"] == {"Yes": "YES", "No": "NO"}

    asks = spark.createDataFrame([("kalshi", "K1", "yes", 0.45, 50.0), ("kalshi", "K1", "no", 0.58, 50.0), ("polymarket", "P1", "yes", 0.60, 80.0), ("polymarket", "P1", "no", 0.41, 80.0)], "venue string, vmid string, outcome string, price double, size double")
    pairs = spark.createDataFrame([("x", "polymarket", "P1", "t1 game 1", "kalshi", "K1", "t", {"Yes": "YES"}, T0, T0)], "pair_key string, venue_a string, vmid_a string, title_a string, venue_b string, vmid_b string, title_b string, outcome_mapping map<string,string>, date_a timestamp, date_b timestamp")
    found = spreads.scan(pairs, asks, F.lit(T0), esports_only=True).collect()
    assert [(r["side_a"], r["side_b"], r["section"]) for r in found] == [("no", "yes", "actionable")] or [(r["side_a"], r["section"]) for r in found] == [("no", "dust")]
    assert spreads.to_price(pairs).count() == 2


def test_rerank_keeps_the_best(spark):
    rows = [(1, 2, 0.9, "a b c", "a b c", ["one two three"], ["one two three", "x"]), (1, 3, 0.8, "a b c", "x y z", ["q"], ["r"]), (1, 4, 0.7, "a b c", "a b c", [], ["r"])]
    df = spark.createDataFrame(rows, "query_id long, candidate_id long, similarity double, event_a string, event_b string, clauses_a array<string>, clauses_b array<string>")
    got = {r["candidate_id"]: r for r in rerank.rerank(df).collect()}
    assert set(got) == {2, 4} and got[2]["secondary"] == 1.0 and got[4]["secondary"] is None and got[2]["match_type"] == "full_match"


# Streams


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def source(spark, tmp_path, rows, schema, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_stream_ttl_dedup(spark, tmp_path):
    live.use_rocksdb(spark)
    events = source(spark, tmp_path, [("a", 1), ("a", 2), ("b", 3)], "k string, v long", "dedup")
    assert sorted(r["k"] for r in run(spark, live.ttl_dedup(events, ["k"]), tmp_path, "dedup_out")) == ["a", "b"]


def test_stream_book_state(spark, tmp_path):
    live.use_rocksdb(spark)
    rows = [("k", "m", 1, 1, "no", 0.58, 7.0), ("k", "m", 2, 1, "no", 0.57, 3.0), ("k", "m", 3, -1, "no", 0.58, 0.0), ("k", "m", 4, -1, "yes", 0.4, 2.0)]
    deltas = source(spark, tmp_path, rows, "venue string, vmid string, seq long, snapshot long, outcome string, price double, size double", "deltas")
    got = {(r["outcome"], r["price"], r["size"]) for r in run(spark, live.books(deltas), tmp_path, "book_out", "update")}
    assert got == {("yes", 0.43, 3.0), ("no", 0.6, 2.0)}
    message = '{"type":"orderbook_delta","msg":{"market_ticker":"T","yes":[[40,2]],"no":[[58,0]]}}'
    levels = live.delta_levels(spark.createDataFrame([(1, message), (2, "{}")], "seq long, payload string")).collect()
    assert [(r["outcome"], r["price"], r["size"]) for r in levels] == [("yes", 0.4, 2.0), ("no", 0.58, 0.0)]


def test_stream_reactions_match_the_batch(spark, tmp_path):
    e = [(1, at(10)), (2, at(20)), (3, at(100))]
    s = [(at(10), "p", "m", 1), (at(15), "k", "m", 2), (at(24), "k", "m", 3)]
    events = source(spark, tmp_path, e, "event_id long, event_ts timestamp", "ev")
    snaps = source(spark, tmp_path, s, "snapshot_ts timestamp, venue string, market_id string, seq long", "sn")
    run(spark, live.reactions(events, snaps), tmp_path, "react_out")
    got = {r["event_id"]: r["latency_ms"] for r in live.first_of(spark.table("react_out")).collect()}
    assert got == {1: 0.0, 2: 4000.0}


def test_stream_distinct_and_throttle(spark, tmp_path):
    rows = [("a", at(0), 1.0), ("a", at(0.1), 2.0), ("b", at(0.3), 3.0)]
    stream = source(spark, tmp_path, rows, "id string, ts timestamp, v double", "dis")
    assert len(run(spark, live.distinct_events(stream, "id", "ts"), tmp_path, "dis_out")) == 2
    batch = spark.createDataFrame(rows, "id string, ts timestamp, v double")
    assert {(r["id"], r["v"]) for r in live.throttled(batch, ["id"], "ts", ["ts"]).collect()} == {("a", 2.0), ("b", 3.0)}


def test_batches_of_several_tables_count_whole(spark, tmp_path):
    root, broken = str(tmp_path / "root"), [True]

    def pairs(batch):
        if broken[0]:
            raise OSError("busy")
        return batch.withColumn("pair", F.lit("p"))

    step = persist.commit_together(root, [("markets", lambda b: b), ("pairs", pairs)])
    with pytest.raises(OSError):
        step(spark.range(3), 7)
    assert persist.committed(spark, root, "markets", "id long").isEmpty()
    broken[0] = False
    step(spark.range(3), 7)
    step(spark.range(5), 7)
    step(spark.range(2), 8)
    assert sorted(map(tuple, persist.committed(spark, root, "markets", "id long").collect())) == [(0, 7), (0, 8), (1, 7), (1, 8), (2, 7)]
    assert persist.committed(spark, root, "pairs", "id long, pair string").count() == 5


def test_only_passing_errors_are_tried_again(spark, tmp_path):
    waits = []
    persist.BatchWriter([lambda b, i: 1 / 0], str(tmp_path / "dead"), sleep=waits.append)(spark.range(1), 1)
    assert not waits and spark.read.json(str(tmp_path / "dead")).count() == 1


def test_counters_of_empty_tables_and_nulls(spark):
    events = spark.createDataFrame([(None, None, None), (None, None, 0), (True, None, 1), (None, True, 2)], "duplicate boolean, failed boolean, candidates long")
    none = spark.createDataFrame([], "verdict string, persisted boolean")
    assert tuple(reports.pipeline_counters(events, none).first()) == (4, 1, 1, 1, 1, 0, 0, 0, 0, 0)
    assert tuple(reports.cache_stats(spark.createDataFrame([], "k long"), "k").first()) == (0, 0, 0.0)


def test_settings_of_the_environment(monkeypatch):
    monkeypatch.setenv("PAIRLENS_TOP_K", "0")
    monkeypatch.setenv("PAIRLENS_BUDGET", "many")
    monkeypatch.setenv("FLAG", "Yes")
    found = config.Settings.of_environment()
    assert (found.top_k, found.budget) == (0, 5000.0)
    assert config.from_env("FLAG", False) is True and config.from_env("ABSENT", 3) == 3


def test_drained_batches_hold_all_rows_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for part in (spark.range(3), spark.range(3, 5)):
        part.coalesce(1).write.mode("append").json(source)
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(source)
        live.drain(live.start_batches(rows, lambda b, i: seen.extend(r.id for r in b.collect()), str(tmp_path / "state"), every="0 seconds"))
        assert sorted(seen) == list(range(len(seen)))
    assert len(seen) == 5


def test_refresh_clears_a_book(spark, tmp_path):
    live.use_rocksdb(spark)
    schema = "venue string, vmid string, seq long, outcome string, price double, size double"
    deltas = spark.createDataFrame([("k", "m", 1, -1, "no", 0.58, 7.0), ("k", "m", 5, -1, "yes", 0.4, 2.0)], "venue string, vmid string, seq long, snapshot long, outcome string, price double, size double")
    fetched = spark.createDataFrame([("k", "m", 3, "no", 0.5, 9.0, at(31)), ("k", "m", 4, "no", 0.4, 1.0, at(32)), ("k", "e", 1, "no", 0.0, 0.0, at(0))], f"{schema}, taken_at timestamp")
    path = str(tmp_path / "levels")
    live.with_refresh(deltas, fetched).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(deltas.schema).parquet(path)
    got = {(r["vmid"], r["outcome"], r["price"], r["size"]) for r in run(spark, live.books(stream), tmp_path, "refresh_out", "update")}
    assert got == {("m", "yes", 0.5, 9.0), ("m", "yes", 0.6, 1.0), ("m", "no", 0.6, 2.0)}


def test_only_fresh_rows_stay(spark):
    rows = spark.createDataFrame([(1, at(0)), (2, at(5)), (3, at(6)), (4, None)], "i int, ts timestamp")
    assert {r["i"] for r in live.still_fresh(rows, "ts", 5.0, F.lit(at(10))).collect()} == {2, 3}


def test_watch_of_one_pair(spark):
    seen = []

    def call(found):
        seen.append(found)
        raise ValueError("a callback's own trouble")

    watch = live.PairWatch(("p", "polymarket", "x", "polymarket", "y", False, None, None), call, as_of=F.lit(T0))

    def book(*rows):
        return spark.createDataFrame(rows, live.PairWatch.LEVEL)

    watch(book(("polymarket", "x", "yes", 0.40, 100.0), ("polymarket", "x", "no", 0.61, 50.0), ("polymarket", "other", "yes", 0.1, 1.0)), 0)
    assert not seen and watch.updates == 1
    watch(book(("polymarket", "y", "yes", 0.47, 80.0), ("polymarket", "y", "no", 0.55, 60.0)), 1)
    best = {(r["side_a"], r["side_b"]): r for r in seen}
    assert set(best) == {("yes", "no"), ("no", "yes")}
    assert best["yes", "no"]["gross_edge"] == 0.05 and best["yes", "no"]["optimal_qty"] == 60.0
    watch(book(("polymarket", "other", "yes", 0.1, 1.0)), 2)
    assert len(seen) == 2 and watch.updates == 2


def test_rebroadcast_drops_failing_clients(spark):
    got, tries = [], []

    def broken(line):
        tries.append(line)
        raise OSError("gone")

    sink = live.Rebroadcast(lambda: [broken, got.append])
    assert sink.open(0, 0)
    for r in spark.createDataFrame([(1, T0), (2, None)], "a int, t timestamp").collect():
        sink.process(r)
    sink.close(None)
    assert len(tries) == 1 and [line[:7] for line in got] == ['{"a": 1', '{"a": 2']


def test_heartbeat(spark, tmp_path):
    now = [0.0]
    health = live.Health(lambda: now[0])
    health.progress = {"x": {"rows": 3, "state": "running", "heard": 0.0}, "y": {"rows": 4, "state": "failed", "heard": 0.0}}
    now[0] = 61.0
    assert health.beat() == {"status": "running", "running": 1, "stopped": 0, "failed": 1, "rows": 7, "silent": ["x"]}


def test_bounded_files_come_in_parts(spark, tmp_path):
    path, sizes = str(tmp_path / "many"), []
    spark.range(6).repartition(3).write.json(path)
    live.drain(live.start_batches(live.bounded_files(spark, path, "id long", files=1), lambda b, i: sizes.append(b.count()), str(tmp_path / "bounded"), every="0 seconds"))
    assert sum(sizes) == 6 and len(sizes) == len(list((tmp_path / "many").glob("part-*")))


def test_verification_by_ids_leaves_out_what_lacks_a_spec(spark):
    events = [("kalshi", "A", "Will the Lakers win 50 games?"), ("polymarket", "B", "Will LA Lakers win 50 games?")]
    texts = spark.createDataFrame([(m, f"Market Statement:\n{t}") for _, m, t in events], "content_hash string, canonical_text string")
    specs = matching.extracted(texts).withColumn("spec_id", F.concat("content_hash", F.lit("_spec"))).drop("content_hash")
    matches = spark.createDataFrame([("A", "B", 0.95), ("A", "Z", 0.95)], "market_a_id string, market_b_id string, score double")
    got = matching.verify_by_id(matches, specs).collect()
    assert [(r["market_a_id"], r["market_b_id"]) for r in got] == [("A", "B")] and got[0]["pair_key"]


def test_points_and_lines(spark):
    schema = "venue string, venue_market_id string, title string, resolution_criteria string, description string, end_date timestamp, outcomes array<struct<label:string>>"
    rows = [("kalshi", "A", "Will it rain?", None, None, None, None), ("nowhere", "B", "x", None, None, None, None), ("kalshi", "C", None, None, None, None, None)]
    points = matching.vector_points(spark.createDataFrame(rows, schema)).collect()
    assert [(p["venue_market_id"], len(p["point_id"]), len(p["vector"])) for p in points] == [("A", 36, 256)]
    found = spark.createDataFrame([("a|" + "b" * 60, "yes", "no", 0.4, 0.55, 0.05, 0.05, 1234.5, 2.0, None, "actionable")], "pair_key string, side_a string, side_b string, ask_a double, ask_b double, gross_edge double, net_profit_1 double, pnl_at_budget double, daily_yield_bps double, days_to_resolution int, section string")
    line = reports.opportunity_lines(found).first()["line"]
    assert line.startswith("actionable  a|") and "at budget 1,234.50" in line and line.endswith("days N/A")
