import random

import pytest
from pyspark.sql import functions as F

from pairlens.config import Settings
from pairlens.operators import books

RATES = {"a": 0.0, "b": 0.07}


def make(rng):
    prices = sorted(rng.sample(range(20, 70), rng.randrange(1, 7)))
    return [(p / 100, float(rng.randrange(1, 400))) for p in prices]


def cost(levels, rate, q):
    """Cost and fee of q contracts, level by level."""
    c = f = 0.0
    for p, s in levels:
        x = min(q, s)
        c, f, q = c + p * x, f + rate * p * (1 - p) * x, q - x
        if q <= 0:
            break
    return c + f


def bisect(a, b, capital):
    top = min(sum(s for _, s in x) for x in (a, b))
    lo, hi = 0.0, top
    for _ in range(80):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if cost(a, RATES["a"], m) + cost(b, RATES["b"], m) <= capital else (lo, m)
    return lo


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(9)
    pairs = {k: (make(rng), make(rng)) for k in range(40)}
    sched = []
    for i, v in enumerate("ab"):
        rows = [(k, p, s) for k, x in pairs.items() for p, s in x[i]]
        sched.append(books.schedule(spark.createDataFrame(rows, "k int, price double, size double"), ["k"], F.lit(RATES[v])).cache())
    return pairs, sched


def test_curve_equals_level_walk(market):
    pairs, sched = market
    curve = books.pnl_curve(*sched, ["k"], digits=(6, 6, 6)).collect()
    assert len(curve) == 40 * 20
    for r in curve:
        a, b = pairs[r["k"]]
        q = min(sum(s for _, s in x) for x in (a, b)) * r["step"] / 20
        assert r["total_cost"] == pytest.approx(cost(a, 0.0, q) + cost(b, 0.07, q), abs=1e-5)
        assert r["guaranteed_profit"] == pytest.approx(r["quantity"] - r["total_cost"], abs=1e-5)


def test_quantities_of_another_table_meet_schedules(market):
    pairs, sched = market
    points = sched[0].select("k", (F.col("cum_qty") - 0.5).alias("q")).union(sched[0].select("k", "cum_qty"))
    for r in books.interpolated(points, sched[0], ["k"], "a").collect():
        assert r["a_cost"] == pytest.approx(cost(pairs[r["k"]][0], 0.0, r["q"]), abs=1e-6) and r["a_fee"] == 0.0


def test_budget_equals_bisection(market):
    pairs, sched = market
    got = {r["k"]: r for r in books.budget_point(*sched, ["k"], 100.0, (6, 6, 6)).collect()}
    for k, (a, b) in pairs.items():
        top = min(sum(s for _, s in x) for x in (a, b))
        full = cost(a, 0.0, top) + cost(b, 0.07, top)
        q = bisect(a, b, min(100.0, full))
        assert got[k]["quantity"] == pytest.approx(q, abs=1e-4) if q >= 0.5 else k not in got


def test_ladder_equals_a_loop(market):
    pairs, sched = market
    s = Settings(ladder_step=20.0, ladder_rungs=12, ladder_declines=3)
    got = {}
    for r in books.capital_ladder(*sched, ["k"], s, 6).orderBy("k", "rung").collect():
        got.setdefault(r["k"], []).append((r["capital"], r["quantity"]))
    for k, (a, b) in pairs.items():
        top = min(sum(s for _, s in x) for x in (a, b))
        full = cost(a, 0.0, top) + cost(b, 0.07, top)
        want, best, below, target = [], float("-inf"), 0, 20.0
        while target <= full + 1e-9:
            q = bisect(a, b, target)
            want.append((target, pytest.approx(q, abs=1e-3)))
            p = round(q - target, 4)
            best, below = (p, 0) if p > best else (best, below + 1)
            if below >= 3 or len(want) >= 12:
                break
            target += 20.0
        assert got.get(k, []) == want


def test_opportunities_by_hand(spark):
    levels = [("polymarket", "p", "yes", 0.40, 100.0), ("polymarket", "p", "no", 0.62, 100.0), ("kalshi", "k", "yes", 0.45, 50.0), ("kalshi", "k", "no", 0.50, 50.0), ("kalshi", "bad", "yes", 0.30, 9.0), ("kalshi", "bad", "no", 0.30, 9.0)]
    asks = spark.createDataFrame(levels, "venue string, vmid string, outcome string, price double, size double")
    rows = [("one", "polymarket", "p", "kalshi", "k", False, "2026-03-11 00:00:00", None), ("two", "polymarket", "p", "kalshi", "bad", False, None, None), ("x", "polymarket", "p", "kalshi", "k", True, None, None)]
    pairs = spark.createDataFrame(rows, "pair_key string, venue_a string, vmid_a string, venue_b string, vmid_b string, inverted boolean, date_a string, date_b string")
    pairs = pairs.withColumns({c: F.col(c).cast("timestamp") for c in ("date_a", "date_b")})
    found = books.opportunities(pairs, asks, F.lit("2026-03-01 00:00:00").cast("timestamp")).cache()
    by = {(r["pair_key"], r["side_a"]): r for r in found.collect()}
    assert set(by) == {("one", "yes"), ("one", "no"), ("x", "yes")} or set(by) == {("one", "yes"), ("one", "no"), ("x", "yes"), ("x", "no")}
    best = by["one", "yes"]
    assert best["gross_edge"] == 0.10 and best["net_profit_1"] == pytest.approx(0.0825) and best["days_to_resolution"] == 10
    assert best["optimal_qty"] == 50.0 and best["max_profit"] == pytest.approx(50 * 0.0825)
    assert best["pnl_at_budget"] == pytest.approx(4.12, abs=0.011) and by["one", "no"]["gross_edge"] == -0.07
    assert [r["pair_key"] for r in books.ranked(found).collect()][0] in ("one", "x")
    assert books.portfolio(found).first()["opportunities"] >= 1 and books.near_misses(found).count() <= 5
