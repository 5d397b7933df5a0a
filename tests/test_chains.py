import datetime
import random

import pytest

from pairlens.operators import chains, dedup

T0 = datetime.datetime(2026, 3, 1)


def rows_of(seed, n, keys, span, step=1.0):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), T0 + datetime.timedelta(seconds=round(rng.random() * span / step) * step) if rng.random() < 0.98 else None) for i in range(n)]


@pytest.mark.parametrize(
    ("seed", "n", "keys", "span", "ttl", "slices"),
    [
        # One key without a gap, over many slices.
        (1, 3000, ["k"], 3000, 7, 3),
        (2, 2000, ["a", "b", None], 20_000, 60, 4),
        # Ties: many rows a second.
        (3, 800, ["a", "b"], 60, 2, 16),
        (4, 300, ["a", "b", "c"], 10**6, 3600, 16),
    ],
)
def test_equal_to_the_fold(spark, seed, n, keys, span, ttl, slices):
    df = spark.createDataFrame(rows_of(seed, n, keys, span), "i long, k string, t timestamp")
    want = sorted(r["i"] for r in dedup.ttl_dedup(df, ["k"], "t", ["i"], ttl).collect())
    assert sorted(r["i"] for r in chains.ttl_dedup(df, ["k"], "t", ["i"], ttl, slices).collect()) == want and len(want) > 20


def test_one_key_runs_in_many_groups(spark):
    df = spark.createDataFrame(rows_of(5, 4000, ["k"], 4000), "i long, k string, t timestamp")
    width = 16 * 5
    spread = df.where("t IS NOT NULL").selectExpr(f"pmod(xxhash64(k, floor(unix_seconds(t) / {width})), 32) AS g").groupBy("g").count().collect()
    assert len(spread) > 16 and max(r["count"] for r in spread) < 1000


def test_empty_tables_and_wrong_times(spark):
    df = spark.createDataFrame([], "i long, k string, t timestamp")
    assert chains.ttl_dedup(df, ["k"], "t", ["i"]).collect() == []
    nulls = spark.createDataFrame([(1, None, None), (2, "a", None)], "i long, k string, t timestamp")
    assert chains.ttl_dedup(nulls, ["k"], "t", ["i"]).count() == 2
    with pytest.raises(ValueError):
        chains.ttl_dedup(df, ["k"], "t", ["i"], 0)
