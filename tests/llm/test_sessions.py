import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pairlens.llm import sessions
from pairlens.llm.sessions import MINUTE, Rules

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"
BEGIN = datetime(2024, 1, 1)


def us(t):
    return round(t.replace(tzinfo=timezone.utc).timestamp()) // 1 * 1_000_000 + t.microsecond if t else None


def plain(rows, rules):
    """Click by click, one client after the other."""
    once = {}
    for i, ts, arrived, client, kind, value in sorted((r for r in rows if None not in (r[0], r[1], r[3])), key=lambda r: (r[1], r[2] or datetime.min, r[3])):
        once.setdefault(i, (us(ts), us(arrived), client, bool(kind == "error" and value is not None and value >= 60), int((100 * value + 0.5) // 1) if value is not None else 0))
    found = []
    for client in {c[2] for c in once.values()}:
        own = [(at, i, arrived, final, cents) for i, (at, arrived, c, final, cents) in once.items() if c == client]
        timely = sorted((at, i, final, cents) for at, i, arrived, final, cents in own if arrived is None or arrived - at <= rules.lateness)
        late = [at for at, _, arrived, _, _ in own if arrived is not None and arrived - at > rules.lateness]
        lists, why = [], []
        for k, click in enumerate(timely):
            if k:
                prior = timely[k - 1]
                reason = "end" if prior[2] else "gap" if click[0] - prior[0] >= rules.gap else "length" if click[0] - lists[-1][0][0] > rules.longest else None
                if reason is None:
                    lists[-1].append(click)
                    continue
                why.append(reason)
            lists.append([click])
        for k, run in enumerate(lists):
            until = lists[k + 1][0][0] if k + 1 < len(lists) else float("inf")
            reason = why[k] if k < len(why) else "end" if run[-1][2] else "none"
            found.append((client, run[0][1], run[0][0], run[-1][0], len(run), sum(run[0][0] <= t < until for t in late), sum(c[3] for c in run), reason, ",".join(str(c[1]) for c in run)))
    return sorted(found)


def made(seed, n, clients, minutes, finals=0.02, tick=1.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = BEGIN + timedelta(minutes=round(rng.random() * minutes / tick) * tick, microseconds=rng.choice([0, 0, 1]))
        arrived = rng.choice([ts, ts + timedelta(minutes=360), ts + timedelta(minutes=361), ts + timedelta(days=2), None]) if rng.random() < 0.3 else ts
        kind = "error" if rng.random() < finals else rng.choice(["view", None, "click"])
        rows.append((i, ts, arrived, rng.randrange(clients), kind, rng.choice([None, 60.0, 59.994, -3.005, 100.25])))
    return rows


def run(spark, rows, rules):
    got = sessions.sessions(spark.createDataFrame(rows, SCHEMA), rules).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize(
    ("seed", "n", "clients", "minutes", "finals", "tick"),
    [
        (1, 900, 3, 3000, 0.02, 1.0),
        # One client without a hard break for days: starts depend on starts slice after slice.
        (2, 1500, 1, 4000, 0.0, 0.25),
        (3, 1200, 2, 2500, 0.002, 0.5),
        # Ties: many clicks a minute.
        (4, 600, 2, 120, 0.1, 1.0),
        (5, 200, 40, 9000, 0.1, 1.0),
    ],
)
def test_equals_click_by_click(spark, seed, n, clients, minutes, finals, tick):
    rows = made(seed, n, clients, minutes, finals, tick)
    for slice_ in (50, 360):
        rules = Rules(slice_=slice_ * MINUTE)
        assert run(spark, rows, rules) == plain(rows, rules)


def test_chains_run_over_slices_without_a_break(spark):
    rows = made(2, 1500, 1, 4000, 0.0, 0.25)
    rules = Rules(slice_=50 * MINUTE)
    timely = sessions.narrowed(spark.createDataFrame(rows, SCHEMA), rules).where("NOT late")
    lines = sessions.dealt(sessions.around(timely, rules), 4)
    heads = lines.groupBy("g").applyInArrow(lambda t: sessions._heads(t, rules), sessions._HEADS)
    assert heads.where("kind = 3").count() > 500


def test_repeats_nulls_and_other_columns(spark):
    rows = made(6, 300, 4, 600)
    broken = [(7, None, None, 1, "view", 1.0), (8000, None, BEGIN, 1, "view", 1.0), (8001, BEGIN, BEGIN, None, "error", 99.0), (None, BEGIN, BEGIN, 1, "view", 1.0), (8002, BEGIN, BEGIN, 77, "error", float("nan")), (8003, BEGIN, BEGIN, 78, "view", float("inf"))]
    rules = Rules()
    frame = spark.createDataFrame(rows + rows[:50] + broken, SCHEMA).withColumns({"id": F.lit("x"), "slice": F.lit(1), "final": F.lit(True), "n": F.lit(None).cast("int")})
    got = {r["session_id"]: r for r in sessions.sessions(frame).collect()}
    # Not a number is the greatest number, as in SQL, and adds nothing.
    assert got[8002]["value_cents"] == got[8003]["value_cents"] == 0 and got[8002]["closed_by"] == "end"
    assert sorted(tuple(r) for r in got.values() if r["client_id"] < 77) == plain(rows, rules)


def test_late_clicks_far_from_any_click(spark):
    late = [(100 + k, BEGIN + timedelta(days=d), BEGIN + timedelta(days=d + 1), 1, "view", 1.0) for k, d in enumerate([-3, 0, 5, 5, 9, 40])]
    rows = [(1, BEGIN, BEGIN, 1, "view", 1.0), (2, BEGIN + timedelta(days=8), None, 1, "view", 2.0), *late, (300, BEGIN, BEGIN + timedelta(days=3), 2, "view", 1.0)]
    got = run(spark, rows, Rules())
    assert got == plain(rows, Rules()) and [r[5] for r in got] == [3, 2]


def test_one_client_is_dealt_to_many_groups(spark):
    rows = made(9, 2000, 1, 60 * 24 * 20)
    dealt = sessions.dealt(sessions.around(sessions.narrowed(spark.createDataFrame(rows, SCHEMA), Rules()), Rules()), 64)
    sizes = [r["count"] for r in dealt.groupBy("g").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 300


def test_empty_table_and_bad_rules(spark):
    assert run(spark, [], Rules()) == []
    only_late = [(1, BEGIN, BEGIN + timedelta(days=1), 1, "view", 1.0)]
    assert run(spark, only_late, Rules()) == []
    with pytest.raises(ValueError, match="as long as"):
        Rules(slice_=MINUTE)
    zoned = spark.createDataFrame(made(3, 60, 2, 300), SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(tuple(r) for r in sessions.sessions(zoned).collect()) == plain(made(3, 60, 2, 300), Rules())
