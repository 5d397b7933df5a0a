import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairlens.config import VERDICTS
from pairlens.functions import scores
from pairlens.operators import entities
from pairlens.plans.matching import verified
from pairlens.schemas import ENTITY, THRESHOLD, quarantined

SIDE = f"entities_{{0}} array<{ENTITY}>, thresholds_{{0}} array<{THRESHOLD}>, resolution_date_{{0}} timestamp, data_source_{{0}} string, outcome_labels_{{0}} array<string>"
SCHEMA = "market_a_id string, market_b_id string, score double, " + SIDE.format("a") + ", " + SIDE.format("b")
YES_NO = ["Yes", "No"]


def side(name=None, value=None, date="2026-12-31", source="Coinbase", labels=YES_NO):
    e = [{"name": n, "entity_type": "other", "aliases": []} for n in ([name] if isinstance(name, str) else name or [])]
    t = [{"value": value, "unit": "dollars", "comparison": ">", "is_negated": False, "negation_context": None}] if value else []
    import datetime

    return (e, t, datetime.datetime.fromisoformat(date) if date else None, source, labels)


GOLDEN = [
    ("same threshold", side("Bitcoin", 60000.0), side("Bitcoin", 60000.0), 0.85, "equivalent", 0.85, 1.0),
    ("other threshold", side("Bitcoin", 60000.0), side("Bitcoin", 80000.0), 0.5, "not_equivalent", 0.0, 0.8),
    ("other entity", side("Bitcoin", 60000.0), side("Ethereum", 60000.0), 0.5, "not_equivalent", 0.0, 0.8),
    ("close thresholds", side("Bitcoin", 60000.0), side("Bitcoin", 62000.0), 0.7, "needs_review", 0.5, 0.9),
    ("no entities", side(None, 60000.0), side(None, 60000.0), 0.85, "equivalent", 0.8, 1.0),
    ("aliases", side("Bitcoin", 60000.0), side("BTC", 60000.0), 0.85, "equivalent", 0.85, 1.0),
    ("missing dates", side("Bitcoin", 60000.0, date=None), side("Bitcoin", 60000.0, date=None), 0.7, "needs_review", 0.5, 1.0),
    ("other sources", side("Bitcoin", 60000.0), side("Bitcoin", 60000.0, source="Binance"), 0.7, "needs_review", 0.5, 0.9),
    ("a month apart", side("Bitcoin", 60000.0), side("Bitcoin", 60000.0, date="2026-12-01"), 0.85, "not_equivalent", 0.0, 1.0),
    ("low score", side("Bitcoin", 60000.0), side("Bitcoin", 60000.0), 0.3, "not_equivalent", 0.3, 0.3),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"k:{i}", f"p:{i}", ce, *a, *b) for i, (_, a, b, ce, *_) in enumerate(GOLDEN)]
    return {r["market_a_id"]: r for r in verified(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)), ids=[g[0] for g in GOLDEN])
def test_golden_pairs(judged, i):
    _, _, _, ce, want, low, high = GOLDEN[i]
    row = judged[f"k:{i}"]
    assert row["verdict"] == want and low - 1e-9 <= row["confidence"] <= high + 1e-9
    assert row["pair_key"] == f"k:{i}_p:{i}"
    assert row["outcome_mapping"] == ({} if ce < 0.5 else {"Yes": "YES", "No": "NO"})


def test_verdict_is_total(spark):
    grid = [(float(a), float(b), float(c), float(d), float(w), e, t) for a, b, c, d, w, e, t in itertools.product((0, 0.5, 0.7, 1), (0, 0.4, 0.8, 1), (0, 0.3, 0.8), (0.3, 0.5, 1), (0, 0.5, 0.9), (True, False), (True, False))]
    df = spark.createDataFrame(grid, "ce double, en double, th double, da double, w double, ei boolean, ti boolean")
    verdict, confidence = scores.verdict(*[F.col(c) for c in ("ce", "en", "th", "da", "w", "ei", "ti")], False, True)
    rows = df.select(verdict.alias("v"), confidence.alias("c")).collect()
    assert {r["v"] for r in rows} == set(VERDICTS) and all(0 <= r["c"] <= 1 for r in rows)


def test_outcome_mapping_and_inversion(spark):
    cases = [(YES_NO, ["no", "yes"]), (["A", "B"], YES_NO), (["x", "y", "z"], ["1", "2", "3"])]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>").withColumn("m", scores.outcome_mapping(F.col("a"), F.col("b")))
    rows = df.withColumn("i", scores.is_inverted(F.col("m"))).collect()
    assert [r["m"] for r in rows] == [{"Yes": "YES", "No": "NO"}, {}, {"x": "1", "y": "2", "z": "3"}]
    crossed = spark.range(1).select(scores.is_inverted(F.create_map(F.lit(" yes"), F.lit("NO"))).alias("i")).first()
    assert not any(r["i"] for r in rows) and crossed["i"]


def model_entities(a, b, lookup):
    """Step by step: exact names in order of A, then each rest of A with its best free B."""
    if not a or not b:
        return 0.5, 0, 0
    canon = lambda e: [lookup.get(n.lower(), n.lower()) for n in (e["name"], *(e["aliases"] or ()))]
    used, hits, wrong = set(), set(), 0
    firsts = {}
    for j, e in enumerate(b):
        for n in canon(e):
            firsts.setdefault(n, j)
    seen = set()
    for i, e in enumerate(a):
        for n in canon(e):
            if n in seen:
                continue
            seen.add(n)
            j = firsts.get(n)
            if j is not None and j not in used and i not in hits:
                used.add(j), hits.add(i)
                wrong += e["entity_type"] != b[j]["entity_type"]
    for i, e in enumerate(a):
        if i in hits:
            continue
        best, at = 0.0, None
        for j, o in enumerate(b):
            x, y = set(e["name"].lower().split()), set(o["name"].lower().split())
            s = len(x & y) / len(x | y) if x and y else 0.0
            if j not in used and s > best:
                best, at = s, j
        if at is not None and best >= 0.5:
            used.add(at), hits.add(i)
            wrong += e["entity_type"] != b[at]["entity_type"]
    total = max(len(a), len(b))
    return max(0.0, len(hits) / total - wrong / total * 0.3), len(hits), wrong


def test_greedy_entity_match_equals_a_plain_model(spark):
    rng = random.Random(6)
    names = ["Bitcoin", "BTC", "New York Mets", "New York", "Mets", "York", "Federal Reserve", "the fed", "Ada Lovelace", "", "ADA\u2003lovelace ", "New  York\x1cMets Fans"]

    def drawn():
        return [(rng.choice(names), rng.choice(["person", "other"]), rng.choice([None, [], [rng.choice(names)], rng.sample(names, 2)])) for _ in range(rng.randrange(0, 6))]

    rows = [(i, drawn(), drawn()) for i in range(600)]
    df = spark.createDataFrame(rows, f"i int, a array<{ENTITY}>, b array<{ENTITY}>")
    lookup = entities.alias_lookup()
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", entities.entity_score(F.col("a"), F.col("b")).alias("x")).collect()}
    named = lambda side: [dict(zip(("name", "entity_type", "aliases"), e)) for e in side]
    for i, a, b in rows:
        assert got[i] == pytest.approx(model_entities(named(a), named(b), lookup)), (a, b)
    empty = spark.createDataFrame([(None, None)], f"a array<{ENTITY}>, b array<{ENTITY}>").select(entities.entity_score(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert tuple(empty) == (0.5, 0, 0)
    assert "Python" not in df.select(entities.entity_score(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()


def test_threshold_lists(spark):
    t = lambda v, **k: {"value": v, "unit": "dollars", "comparison": ">", "is_negated": False, "negation_context": None, **k}
    cases = [([], [], 0.5), ([t(1.0)], [], 0.0), ([t(100.0)], [t(100.9)], 1.0), ([t(100.0)], [t(109.0)], 0.0), ([t(100.0), t(200.0)], [t(104.0)], 0.5), ([t(100.0)], [t(100.0, is_negated=True)], 0.0), ([t(100.0)], [t(100.0, unit="numeric")], 0.0)]
    df = spark.createDataFrame(cases, f"a array<{THRESHOLD}>, b array<{THRESHOLD}>, want double")
    assert [r[0] for r in df.select(scores.threshold_score(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_dates_depend_on_order(spark):
    row = spark.range(1).select(
        scores.days_apart(F.lit("2026-01-02 12:00:00").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")).alias("a"),
        scores.days_apart(F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02 12:00:00").cast("timestamp")).alias("b"),
        scores.date_gap_class(F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-03").cast("timestamp")).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (1, 2, "possibly_same")


def test_quarantine(spark):
    df = spark.createDataFrame([("kalshi", 0.5), ("nowhere", 0.5), ("kalshi", 1.5), (None, None)], "venue string, confidence double")
    good, bad = quarantined(df)
    assert good.count() == 2 and sorted(r["failed_checks"] for r in bad.collect()) == [["confidence"], ["venue"]]


def test_normalised_text_equals_a_plain_model(spark):
    import random

    from pairlens.functions import text

    blank = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　"

    def model(t):
        lines = [x.rstrip(blank) for x in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        return "\n".join(x for i, x in enumerate(lines) if i == 0 or x or lines[i - 1]).rstrip("\n")

    rng = random.Random(5)
    texts = [None, "", "\n\n\n", "a" + " " * 20000 + "b"] + ["".join(rng.choice(["a", "b c", "\n", "\n\n", "\r\n", "\r", " ", "\t", " ", "\x85", "é"]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["n"] for r in df.select("i", text.normalise_text(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [model(t) for t in texts]


def test_moving_averages_equal_the_fold(spark):
    import random

    from pairlens.operators import latency

    rng = random.Random(6)
    rows = [(k, i, rng.choice([0.0, 0.0, 1.5, 7.25, 3.0])) for k in range(12) for i in range(rng.randrange(1, 60))] + [(99, 0, 0.0), (99, 1, 0.0)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {r["k"]: r["ema"] for r in latency.moving_averages(df, ["k"], ["i"], "v").collect()}
    for k in {r[0] for r in rows}:
        ema = 0.0
        for _, _, v in sorted(r for r in rows if r[0] == k):
            ema = v if ema == 0 else 0.9 * ema + 0.1 * v
        assert abs(got[k] - ema) < 1e-9


def test_first_reactions_equal_brute_force(spark):
    import random
    from datetime import datetime, timedelta

    from pairlens.operators import latency

    rng = random.Random(7)
    start = datetime(2026, 1, 1)
    at = lambda ms: start + timedelta(milliseconds=ms)
    events = [(i, at(rng.randrange(40_000)), f"m{i % 3}") for i in range(300)] + [(900, None, "m0")]
    snaps = [(at(rng.randrange(40_000)), f"m{i % 3}", i) for i in range(120)] + [(events[0][1], "m0", 500), (events[0][1], "m0", 501)]
    left = spark.createDataFrame(events, "event_id long, event_ts timestamp, market string")
    right = spark.createDataFrame(snaps, "snapshot_ts timestamp, market string, seq long")
    for keys in ([], ["market"]):
        got = {r["event_id"]: (r["latency_ms"], r["seq"]) for r in latency.first_reactions(left, right if keys else right.drop("market"), 1_000.0, keys, ["seq"]).collect()}
        want = {}
        for i, ts, m in events:
            near = sorted((s[0], s[2]) for s in snaps if ts and (not keys or s[1] == m) and timedelta(0) <= s[0] - ts <= timedelta(seconds=1))
            if near:
                want[i] = ((near[0][0] - ts) / timedelta(milliseconds=1), near[0][1])
        assert got == want
